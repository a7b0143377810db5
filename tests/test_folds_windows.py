import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from wattpanel.operators import folds as K
from wattpanel.operators import metrics as M
from wattpanel.operators import windows as W

B = dt.datetime(2024, 1, 1)


def _hours(spark, n=24 * 40):
    return spark.createDataFrame([(i, B + dt.timedelta(hours=i)) for i in range(n)], "row_id long, datetime timestamp")


def test_temporal_folds_bounds(spark):
    out = K.temporal_folds(_hours(spark), ["2024-01-10"]).collect()
    r = {x.row_id: x.role for x in out}
    assert r[9 * 24] == "train" and r[9 * 24 + 1] == "val"


def test_monthly_folds_complete_and_disjoint(spark):
    df = _hours(spark, 24 * 70)
    out = K.monthly_folds(df, ["2024-01", "2024-02"], 168)
    per = out.groupBy("fold").agg(F.count("*").alias("n"), F.sum(F.when(F.col("role") == "val", 1)).alias("v"))
    got = {r.fold: (r.n, r.v) for r in per.collect()}
    # January: Jan 1 00:00 .. Jan 25 00:00 both included -> 24 * 24 + 1 rows
    assert got["f-2024-1"] == (24 * 70, 24 * 24 + 1)
    assert got["f-2024-2"][1] == 22 * 24 + 1


def test_date_split_excludes_exact(spark):
    tr, va = K.date_split(_hours(spark), "2024-01-02 00:00:00")
    assert tr.count() + va.count() == 24 * 40 - 1


def test_segment_tail_split(spark):
    rows = [("a", (B + dt.timedelta(days=d)).date()) for d in range(250)] + [("b", B.date()), ("b", B.date())]
    df = spark.createDataFrame(rows, "seg string, date date")
    out = K.segment_tail_split(df, ["seg"], "date", 100)
    got = out.groupBy("seg", "role").count().collect()
    assert {(r.seg, r.role): r["count"] for r in got} == {("a", "train"): 149, ("a", "val"): 101, ("b", "train"): 2}


def test_global_row_index_dense(spark):
    vals = [random.Random(1).random() for _ in range(1)] + [random.Random(i).random() for i in range(2, 500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "x double, k long")
    idx = sorted((r._idx, r.x) for r in W.global_row_index(df, ["x", "k"], "_idx", 4).collect())
    assert [i for i, _ in idx] == list(range(len(vals)))
    assert [x for _, x in idx] == sorted(vals)


def test_rolling_rows_by_value_matches_pandas(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50) * 1.0, i, float(rng.randint(1, 9))) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, k long, y double")
    got = W.rolling_rows_by_value(df, ["x", "k"], "y", 7, bucket_rows=40).toPandas().sort_values(["x", "k"])
    pdf = pd.DataFrame(rows, columns=["x", "k", "y"]).sort_values(["x", "k"]).reset_index(drop=True)
    r = pdf["y"].rolling(7)
    want = pd.DataFrame({"mean": r.mean(), "max": r.max(), "median": r.median(), "q25": r.quantile(0.25),
                         "q75": r.quantile(0.75)})
    for c in want.columns:
        a, b = got[f"rolling_{c}"].to_numpy(), want[c].to_numpy()
        assert ((abs(a - b) < 1e-9) | (pd.isna(a) & pd.isna(b))).all(), c


def test_rolling_sum_time_halo_matches_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, B + dt.timedelta(hours=h), float(rng.randint(0, 5))) for k in (1, 2) for h in range(0, 200, 3)]
    df = spark.createDataFrame(rows, "k int, t timestamp, x double")
    got = {(r.k, r.t): r.s for r in W.rolling_sum_time(df, ["k"], "t", "x", 86400, "s",
                                                        chunk_seconds=2 * 86400).collect()}
    for k, t, _ in rows:
        want = sum(x for k2, t2, x in rows if k2 == k and t - dt.timedelta(days=1) < t2 <= t)
        assert got[(k, t)] == want


def test_every_kth_and_minmax(spark):
    df = spark.createDataFrame([(float(i % 17), i) for i in range(100)], "x double, k long")
    kept = W.every_kth(df, ["x", "k"], 10).count()
    assert kept == 10
    r = W.minmax_scale(df, "x").agg(F.min("x_scaled"), F.max("x_scaled")).first()
    assert (r[0], r[1]) == (0.0, 1.0)


def test_exact_quantiles_linear(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 10]], "v double")
    assert M.exact_quantiles(df, "v", [0.5, 0.25, 0.9]) == [3.0, 2.0, 7.6000000000000005]


def test_sliding_sum_window_edges(spark):
    rows = [(1, B + dt.timedelta(hours=h), 1.0) for h in range(0, 72)]
    df = spark.createDataFrame(rows, "county int, datetime timestamp, rain double")
    got = {r.datetime: r.s for r in W.sliding_sum(df, ["county"], "datetime", "rain", "2 days", "1 day", "s").collect()}
    assert got[B + dt.timedelta(days=1)] == 24.0 and got[B + dt.timedelta(days=2)] == 48.0
    assert got[B + dt.timedelta(days=4)] == 24.0


def test_several_rolling_sums_share_one_window(spark):
    import random

    from wattpanel.operators.windows import Rolling, rolling_sums_time

    rng = random.Random(6)
    rows = sorted({(k, rng.randrange(0, 40 * 24)) for k in (1, 2) for _ in range(500)})
    vals = {r: (None if rng.random() < 0.1 else float(rng.randrange(9))) for r in rows}
    df = spark.createDataFrame([(k, h, vals[k, h]) for k, h in rows], "k long, h long, v double").withColumn("t", F.timestamp_seconds(F.col("h") * 3600))
    sums = [Rolling("v", 86400, "a"), Rolling("v", 3 * 86400, "b", fill_null=None), Rolling("v", 86400, "c", shift=3600)]
    out = rolling_sums_time(df, ["k"], "t", sums, chunk_seconds=5 * 86400)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1

    def total(k, h, hours):
        xs = [vals[k, x] for x in range(h - hours + 1, h + 1) if vals.get((k, x)) is not None]
        return sum(xs) if xs else None

    for r in out.collect():
        assert (r.a, r.b) == (total(r.k, r.h, 24) or 0.0, total(r.k, r.h, 72))
        assert r.c == ((total(r.k, r.h - 1, 24) or 0.0) if (r.k, r.h - 1) in vals else 0.0)


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    from wattpanel.session import bounded_broadcast

    def hinted(df, **kw):
        return "ResolvedHint" in bounded_broadcast(df, **kw)._jdf.queryExecution().analyzed().toString()

    narrow = spark.range(1000)
    wide = narrow.select("id", F.repeat(F.lit("x"), 10_000).alias("s"), F.sequence(F.lit(0), F.lit(99)).alias("a"))
    assert hinted(narrow) and not hinted(narrow, max_rows=999)
    assert hinted(wide, max_bytes=20 << 20) and not hinted(wide, max_bytes=5 << 20)
    assert not hinted(wide.select("id", "a"), max_bytes=400_000) and hinted(spark.range(0).select("id"), max_bytes=0)
