import datetime as dt

from pyspark.sql import functions as F

from wattpanel.operators import lags as L

SEG = ["county", "is_business", "product_type", "is_consumption"]


def _panel(spark):
    rows = []
    base = dt.datetime(2024, 1, 1)
    rid = 0
    for county in (0, 1):
        for pt in (0, 1):
            for h in range(0, 24 * 6):
                if (county, pt) == (1, 1) and h < 24 * 3:
                    continue  # a segment with a late start, to force fallback
                rid += 1
                rows.append((county, 0, pt, 0, base + dt.timedelta(hours=h), float(county * 100 + pt * 10 + h), rid))
    return spark.createDataFrame(rows, "county long, is_business long, product_type long, is_consumption int, "
                                       "datetime timestamp, target double, row_id long")


def test_pivot_equals_chain(spark):
    p = _panel(spark)
    items = p.drop("target")
    src = p.select(*SEG, "datetime", "target")
    a = L.lag_join(items, src, SEG, "datetime", ["target"], [24, 48, 72]).orderBy("row_id").collect()
    b = L.lag_join_chain(items, src, SEG, "datetime", ["target"], [24, 48, 72]).orderBy("row_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_pivot_multi_column_equals_chain(spark):
    p = _panel(spark).withColumn("x2", F.col("target") * 2)
    items = p.select("row_id", "county", "datetime")
    src = p.groupBy("county", "datetime").agg(F.sum("target").alias("a"), F.max("x2").alias("b"))
    nm = L.suffix_after_first([0, 24, 48])
    a = L.lag_join(items, src, ["county"], "datetime", ["a", "b"], [0, 24, 48], nm).orderBy("row_id").collect()
    b = L.lag_join_chain(items, src, ["county"], "datetime", ["a", "b"], [0, 24, 48], nm).orderBy("row_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]
    assert "a" in a[0].asDict() and "a_h24" in a[0].asDict()


def test_fallback_levels(spark):
    p = _panel(spark)
    out = L.lag_fallback(p.drop("target"), p, "target", [48]).collect()
    by = {(r.county, r.product_type, r.datetime): r for r in out}
    t = dt.datetime(2024, 1, 4, 5)  # 48 h earlier the late segment (1, 1) has no row
    r = by[(1, 1, t)]
    assert r.target_48h == r["target_all_type_mean_48h"]
    # county 1 mean at t-48h: only product 0 exists then
    assert r.target_48h == 100.0 + 29
    own = by[(0, 1, t)]
    assert own.target_48h == 10.0 + 29


def test_group_levels_roll_up(spark):
    p = _panel(spark)
    by_c, all_c = L.group_levels(p, ["target"])
    direct = p.groupBy("datetime", "is_business", "is_consumption").agg(F.avg("target").alias("m"),
                                                                         F.sum("target").alias("s"))
    j = all_c.join(direct, ["datetime", "is_business", "is_consumption"])
    for r in j.collect():
        assert abs(r.target_mean - r.m) < 1e-9 and abs(r.target_sum - r.s) < 1e-9


def test_lookback_prune_is_literal(spark):
    p = _panel(spark)
    start = L.lookback_min(p.filter(F.col("datetime") >= F.lit("2024-01-04").cast("timestamp")), "datetime")
    pruned = L.lookback_prune(p, "datetime", start, 24)
    assert pruned.agg(F.min("datetime")).first()[0] == dt.datetime(2024, 1, 3)


def test_window_strategy_equals_chain(spark):
    p = _panel(spark)
    items = p.drop("target")
    src = p.select(*SEG, "datetime", "target")
    lags = [0, 24, 48, 72]
    a = L.lag_join(items, src, SEG, "datetime", ["target"], lags, strategy="window").orderBy("row_id").collect()
    b = L.lag_join_chain(items, src, SEG, "datetime", ["target"], lags).orderBy("row_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_window_strategy_chunk_halo_and_future_items(spark):
    # small chunks force rows to meet their lags through the halo; items later than all source rows
    p = _panel(spark)
    src = p.select("county", "datetime", "target").groupBy("county", "datetime").agg(F.sum("target").alias("v"))
    later = p.select("row_id", "county", (F.col("datetime") + F.expr("INTERVAL 2 DAYS")).alias("datetime"))
    nm = L.suffix_after_first([0, 24, 48])
    t = L.lag_table_window(later, src, ["county"], "datetime", ["v"], [0, 24, 48], nm, chunk_hours=50)
    a = later.join(t, ["county", "datetime"], "left").orderBy("row_id").collect()
    b = L.lag_join_chain(later, src, ["county"], "datetime", ["v"], [0, 24, 48], nm).orderBy("row_id").collect()
    assert [r.asDict() for r in a] == [r.asDict() for r in b]


def test_only_wanted_times_are_pivoted(spark):
    src = spark.sql("SELECT 1L AS k, timestamp'2024-01-01 00:00:00' AS datetime, 5.0D AS a "
                    "UNION ALL SELECT 2L, timestamp'2024-01-01 00:00:00', 6.0D")
    items = spark.sql("SELECT 1L AS k, timestamp'2024-01-02 00:00:00' AS datetime UNION ALL SELECT 1L, timestamp'2024-01-02 00:00:00' "
                      "UNION ALL SELECT CAST(NULL AS BIGINT), timestamp'2024-01-02 00:00:00'")
    table = L.lag_table(src, ["k"], "datetime", ["a"], [24, 48], L.hours_suffix, items)
    assert [(r.k, r.a_24h, r.a_48h) for r in table.collect()] == [(1, 5.0, None)]
    joined = L.lag_join(items, src, ["k"], "datetime", ["a"], [24, 48])
    assert sorted([(r.k, r.a_24h) for r in joined.collect()], key=str) == [(1, 5.0), (1, 5.0), (None, None)]


def test_chunks_equal_chain(spark):
    p = _panel(spark).withColumn("x2", F.when(F.col("target") % 3 > 0, F.col("target") * 2))
    # times off the hour, lags of several divisors, rows without a time
    p = p.withColumn("datetime", F.expr("datetime + make_interval(0, 0, 0, 0, 0, cast(county * 7 as int))")).withColumn(
        "datetime", F.when(F.col("row_id") % 50 != 0, F.col("datetime")))
    items = p.drop("target", "x2").unionByName(p.drop("target", "x2").filter("row_id < 9").withColumn("county", F.lit(9).cast("long")))
    src = p.select(*SEG, "datetime", "target", "x2").filter("datetime is not null")
    for lags in ([24, 48, 72], [0, 5, 7], [48], [30, 1000]):
        for hours in (None, 24 * 3):
            a = L.lag_join_chunks(items, src, SEG, "datetime", ["target", "x2"], lags, chunk_hours=hours)
            b = L.lag_join_chain(items, src, SEG, "datetime", ["target", "x2"], lags)
            order = ["row_id", "county"]
            cols = [*items.columns, *[f"{c}_{h}h" for h in lags for c in ("target", "x2")]]
            assert a.select(*cols).orderBy(*order).collect() == b.select(*cols).orderBy(*order).collect()


def test_chunks_refuse_duplicated_source_keys(spark):
    import pytest

    p = _panel(spark)
    with pytest.raises(Exception, match="DUPLICATED"):
        L.lag_join(p.drop("target"), p.union(p.limit(1)).select(*SEG, "datetime", "target"), SEG, "datetime", ["target"], [24]).collect()


def test_panel_is_exchanged_once_for_all_lags(spark):
    p = _panel(spark).drop("row_id").repartition(3).cache()
    p.count()
    items = spark.createDataFrame([], p.schema).drop("target")
    plan = L.lag_join(items, p, SEG, "datetime", ["target"], [24 * d for d in range(2, 15)])._jdf.queryExecution().executedPlan().toString()
    source = plan[plan.index("ObjectHashAggregate"):]
    assert source.count("Exchange hashpartitioning") == 1
    assert "explode(CASE WHEN" in source  # two copies of a row at most, not one for each lag
