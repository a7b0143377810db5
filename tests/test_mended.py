"""Large and small values, duplicates, nulls, ties, dates and long names."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import ts
from wattpanel.functions import holidays, scalars
from wattpanel.operators import clean, lags, metrics, windows
from wattpanel.plans import pipeline, rounding, solar


def test_rounding_keeps_magnitude(spark):
    values = [1e12, 5e12 + 0.25, -3e10, 1e-10, 3e-10, -2e-7, 0.1 + 0.2, 1e25, 0.0, None, float("inf")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = [r["v"] for r in rounding.round_doubles(df).orderBy("i").collect()]
    for a, b in zip(got, values):
        assert a == b or abs(a - b) <= max(1e-9 * abs(b), 1e-15), (a, b)
    rows = ", ".join(f"({i}, {'NULL' if v is None else repr(v) if v != float('inf') else chr(39) + 'inf' + chr(39)}::DOUBLE)" for i, v in enumerate(values))
    sql = rounding.round_sql(f"SELECT * FROM (VALUES {rows}) t(i, v)", ["v"])
    assert [r[1] for r in duckdb.sql(sql + " ORDER BY i").fetchall()] == got


@pytest.mark.parametrize("columns", [2, 60])
def test_duplicated_lag_key_raises(spark, columns):
    names = [f"c{i}" for i in range(columns)]
    rows = [(1, ts("2024-01-01 00:00:00"), *[float(i) for i in range(columns)])] * 2
    src = spark.createDataFrame(rows, "k long, t timestamp, " + ", ".join(f"{c} double" for c in names))
    with pytest.raises(Exception, match="DUPLICATE"):
        lags.lag_table(src, ["k"], "t", names, [24, 48], lags.hours_suffix).collect()
    assert lags.lag_table(src.limit(1), ["k"], "t", names, [24, 48], lags.hours_suffix).count() == 2


def test_rolling_rows_longer_than_a_bucket(spark):
    df = spark.createDataFrame([(i, float(i * i % 17)) for i in range(60)], "i long, v double")
    got = {r["i"]: r["rolling_max"] for r in windows.rolling_rows_by_value(df, ["i"], "v", 25, ["max"], bucket_rows=10).collect()}
    assert got == {i: (max(float(j * j % 17) for j in range(i - 24, i + 1)) if i >= 24 else None) for i in range(60)}


def test_holiday_of_any_year(spark):
    days = [dt.date(2030, 4, 21), dt.date(2030, 4, 19), dt.date(2030, 6, 9), dt.date(1990, 12, 24), dt.date(2030, 4, 22), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i long, date date")
    assert [r[0] for r in holidays.add_holiday_flag(df).orderBy("i").select("is_country_holiday").collect()] == [True, True, True, True, False, False]


def test_long_names_stay_whole(spark):
    name = "a" * ((1 << 20) + 5) + "-bC"
    got = spark.createDataFrame([(name,)], "n string").select(scalars.format_name("n")).first()[0]
    assert got == "A" + "a" * ((1 << 20) + 4) + "-Bc"


def test_quantiles_with_ties_and_null_groups(spark):
    rows = [(None if i % 3 == 0 else i % 3, 0.0 if i % 10 else float(i)) for i in range(999)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r["g"]: (r["count"], r["q25"], r["q50"], r["q75"]) for r in metrics.describe(df, "v", ["g"]).collect()}
    for g in (None, 1, 2):
        v = duckdb.sql(f"SELECT quantile_cont(v, 0.25), quantile_cont(v, 0.5), quantile_cont(v, 0.75) FROM (VALUES {', '.join(f'({x}::DOUBLE)' for k, x in rows if k == g)}) t(v)").fetchall()[0]
        assert got[g] == (333, *v)
    tied = spark.range(20000).select(F.when(F.col("id") % 10 > 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"))
    sizes = [r["n"] for r in metrics._value_counts(tied, [], "v").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 2000  # 18,001 equal values are one row
    val = spark.createDataFrame([(None, 1.0), (1, 2.0)], "g long, y double")
    assert metrics.segment_median_baseline(val, val, "g", "y").count() == 2


def test_group_predict_keeps_rows_without_a_group(spark):
    cols = sorted({v for v in solar.REGRESSORS.values() if v})
    df = spark.createDataFrame([(g, *[1.0] * len(cols)) for g in (1, None, 9, 1)], "g long, " + ", ".join(f"`{c}` double" for c in cols))
    params = solar.params_frame(spark, "g", {1: solar.DEFAULT_WEIGHTS, 2: solar.DEFAULT_WEIGHTS})
    out = solar.group_predict(df, params, "g").collect()
    assert len(out) == 4 and len({round(r["prediction"], 9) for r in out}) == 1


def test_upsert_breaks_ties_and_demands_equal_columns(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, v string")
    new = spark.createDataFrame([(2, "x"), (2, "y")], "k long, v string")
    assert sorted(tuple(r) for r in clean.upsert_latest(old, new, ["k"]).collect()) == [(1, "b"), (2, "y")]
    with pytest.raises(ValueError):
        clean.upsert_latest(old, new.drop("v"), ["k"])


def test_features_of_no_items(spark):
    from wattpanel.plans.q_pipeline import feature_inputs

    inputs = feature_inputs(spark, "/root/testdata/sf0.001")
    assert pipeline.build_features(spark, **inputs | {"items": inputs["items"].limit(0)}).count() == 0
