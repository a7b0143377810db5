"""Deterministic output rounding shared by a query and its oracle.

Sums and means taken in different orders differ in the last bits; when the exact
value is a decimal tie (means of 2-decimal data often are), any later rounding can
fall either way.  Double outputs of registered queries are therefore rounded to
``DECIMALS`` places with the same IEEE arithmetic on both sides,
round-half-even of ``x * 1e9`` over 1e9 (NaN and infinities pass through).  The grid is far
finer than the data's own decimals, so both engines land on the same double.  All steps stay in
doubles, so large values keep their magnitude; values under 1e-6 are rounded to 15 places instead.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECIMALS = 9
SCALE = "1e9"
SMALL, FINE = "1e-6", "1e15"
MANIFEST = os.path.join(os.path.dirname(os.path.abspath(__file__)), "double_columns.json")


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def round_doubles(df: DataFrame) -> DataFrame:
    """Round every double column of ``df`` (Spark side)."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            c = _q(name)
            out.append(F.expr(f"CASE WHEN isnan({c}) OR abs({c}) = double('Infinity') THEN {c} "
                              f"WHEN abs({c}) < {SMALL}D THEN CASE WHEN rint({c} * {FINE}D) = 0 THEN 0.0D ELSE rint({c} * {FINE}D) / {FINE}D END "
                              f"ELSE rint({c} * {SCALE}D) / {SCALE}D END").alias(name))
        else:
            out.append(F.col(_q(name)))
    return df.select(*out)


def round_sql(sql: str, cols: Sequence[str]) -> str:
    """Wrap oracle SQL so that ``cols`` are rounded the same way (DuckDB side)."""
    if not cols:
        return sql
    items = []
    for c in cols:
        q = '"' + c.replace('"', '""') + '"'
        items.append(f"CASE WHEN isnan({q}) OR isinf({q}) THEN {q} "
                     f"WHEN abs({q}) < {SMALL} THEN CASE WHEN round_even({q} * {FINE}::DOUBLE, 0) = 0 THEN 0.0::DOUBLE ELSE round_even({q} * {FINE}::DOUBLE, 0) / {FINE}::DOUBLE END "
                     f"ELSE round_even({q} * {SCALE}::DOUBLE, 0) / {SCALE}::DOUBLE END AS {q}")
    return f"SELECT * REPLACE ({', '.join(items)}) FROM (\n{sql}\n) AS _oracle"


def load_manifest() -> dict[str, list[str]]:
    if not os.path.exists(MANIFEST):
        return {}
    with open(MANIFEST) as f:
        return json.load(f)
