import datetime as dt

from pyspark.sql import functions as F

from wattpanel.operators import clean as C
from wattpanel.operators.windows import ffill_limit

B = dt.datetime(2024, 1, 1)


def _series(spark, vals, step_hours=24):
    rows = [(1, B + dt.timedelta(hours=i * step_hours), v) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "k int, t timestamp, x double")


def test_ffill_one_and_two_passes_across_chunks(spark):
    vals = [1.0, None, None, 4.0, None, 6.0, None, None, None, 10.0]
    df = _series(spark, vals, step_hours=30)  # rows fall into different 7-day chunks
    one = [r.x for r in ffill_limit(df, ["k"], "t", "x", passes=1, chunk_days=2).orderBy("t").collect()]
    two = [r.x for r in ffill_limit(df, ["k"], "t", "x", passes=2, chunk_days=2).orderBy("t").collect()]
    assert one == [1.0, 1.0, None, 4.0, 4.0, 6.0, 6.0, None, None, 10.0]
    assert two == [1.0, 1.0, 1.0, 4.0, 4.0, 6.0, 6.0, 6.0, None, 10.0]


def test_upsert_latest_wins_and_idempotent(spark):
    old = spark.createDataFrame([(1, 10.0), (2, 20.0)], "k int, v double")
    new = spark.createDataFrame([(2, 21.0), (3, 30.0)], "k int, v double")
    once = C.upsert_latest(old, new, ["k"])
    assert sorted(tuple(r) for r in once.collect()) == [(1, 10.0), (2, 21.0), (3, 30.0)]
    twice = C.upsert_latest(once, new, ["k"])
    assert sorted(tuple(r) for r in twice.collect()) == sorted(tuple(r) for r in once.collect())


def test_gap_shift_fill(spark):
    rows = [(B + dt.timedelta(hours=h), float(h)) for h in range(0, 96)]
    df = spark.createDataFrame(rows, "t timestamp, x double")
    out = C.gap_shift_fill(df, "t", B + dt.timedelta(hours=10), B + dt.timedelta(hours=20),
                           B + dt.timedelta(hours=58), 48)
    got = {r.t: r.x for r in out.collect()}
    assert got[B + dt.timedelta(hours=58)] == 10.0 and got[B + dt.timedelta(hours=68)] == 20.0
    assert B + dt.timedelta(hours=69) not in got and got[B + dt.timedelta(hours=57)] == 57.0


def test_dropna_drops_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    assert C.dropna_any(df).count() == 1


def test_complement(spark):
    a = spark.range(10).withColumnRenamed("id", "row_id")
    b = a.filter(F.col("row_id") < 3)
    assert C.complement(a, b).count() == 7
