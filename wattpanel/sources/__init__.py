from .io import (  # noqa: F401
    conform,
    parse_date_columns,
    prepare_test_items,
    read_csv,
    read_id_map,
    read_table,
    write_csv,
    write_parquet,
)
