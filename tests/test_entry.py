import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from tools.check import tolerant_equal

SF = "/root/testdata/sf0.001"
FAST = ["lag_fallback", "lag_weather_hist", "weather_to_county", "station_weights", "point_in_polygon",
        "ffill_limit", "upsert_latest", "solar_formula", "monthly_folds", "every_kth", "holiday_calendar",
        "prediction_guard", "sliding_sum_7d", "stations_within_km"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "target_48h" in df.columns


def test_every_query_has_oracle_or_is_known_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    own = {n for n in q if n != "pipeline" and not re.match(r"op\d+_", n)}  # the text queries have tests of their own
    assert own - set(o) == {"gbt_ensemble", "param_stability", "solar_fit",
                               "feature_table", "train_evaluate"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("events", "nation", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    s = E.queries()[name](spark, SF).toPandas()
    o = con.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert tolerant_equal(s, o)


def test_rounding_manifest_in_sync(spark):
    from wattpanel.plans.registry import load_raw
    from wattpanel.plans.rounding import load_manifest

    man = load_manifest()
    qs, ors = load_raw()
    assert set(man) == set(ors)
    for name in FAST:
        df = qs[name](spark, SF)
        assert man[name] == [n for n, t in df.dtypes if t == "double"], name
