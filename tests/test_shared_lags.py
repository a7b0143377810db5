"""Lag joins that share one shuffle of the left side, and what reads them."""

import datetime as dt

from pyspark.sql import functions as F

from wattpanel.operators import geo as G
from wattpanel.operators import lags as L
from wattpanel.operators import metrics as M
from wattpanel.plans import models as MD
from wattpanel.plans import pipeline
from wattpanel.plans import solar as SO

SEG = ["county", "is_business", "product_type", "is_consumption"]


def _panel(spark, hours=24 * 40):
    t0 = F.lit(dt.datetime(2024, 1, 1))
    return spark.range(hours * 4).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("county"), (F.col("id") % 4 > 1).cast("long").alias("is_business"),
        (F.col("id") % 3).alias("product_type"), (F.col("id") % 2).cast("int").alias("is_consumption"),
        (t0 + F.make_dt_interval(F.lit(0), F.floor(F.col("id") / 4).cast("int"))).alias("datetime"), (F.col("id") * 7 % 101).cast("double").alias("target"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_left_side_is_shuffled_once_for_all_sources(spark):
    p = _panel(spark).cache()
    p.count()
    specs = {"target": ([48, 72], [48])}
    own = L.fallback_sources(p, specs)
    items = p.drop("target")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = L.lag_joins(items, own, "datetime")
        plan = _plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one of the items, one of each source's rows, and those of the two levels' sums (the finer one stands in both)
    assert plan.count("Exchange hashpartitioning") <= 1 + 3 + 3
    chained = items
    for s in own:
        chained = L.lag_join_chain(chained, s.src, s.keys, "datetime", s.cols, s.lags)
    cols = chained.columns
    assert sorted(map(str, joined.select(*cols).collect())) == sorted(map(str, chained.collect()))


def test_county_copies_are_not_shuffled(spark):
    st = spark.createDataFrame([(c, float(k), 2.0, 0.5) for c in range(5) for k in range(3)], "county long, latitude double, longitude double, weights double")
    wx = _panel(spark, 5).select("datetime", F.col("product_type").cast("double").alias("latitude"), F.lit(2.0).alias("longitude"), F.col("target").alias("x"))
    out = G.weather_to_county(wx, st, ["x"])
    dealt = [x for x in _plan(out).splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 1 and "hashpartitioning(datetime" in dealt[0]  # by time, before the copies are made
    assert out.count() == 25


def test_feature_table_moves_no_wide_rows(spark):
    p = _panel(spark)
    wx = p.filter("row_id % 4 = 0").select(
        "datetime", F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.col("target").alias("temperature"), F.lit(1.0).alias("dewpoint"),
        F.lit(0.1).alias("rain"), F.lit(0.2).alias("snowfall"), F.lit(3.0).alias("windspeed_10m"), F.lit(90.0).alias("winddirection_10m"))
    fw = p.filter("row_id % 4 = 0").select(
        F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), F.col("datetime").alias("origin_datetime"), F.lit(24).alias("hours_ahead"),
        F.lit(5.0).alias("temperature"), F.lit(1.0).alias("dewpoint"), F.lit(0.1).alias("total_precipitation"), F.lit(0.0).alias("snowfall"),
        F.lit(1.0).alias("10_metre_u_wind_component"), F.lit(1.0).alias("10_metre_v_wind_component"), F.lit(2.0).alias("surface_solar_radiation_downwards"))
    st = spark.createDataFrame([(0, 1.0, 2.0, 0.5), (1, 1.0, 2.0, 0.5)], "county long, latitude double, longitude double, weights double")
    client = p.select("county", "is_business", "product_type", F.to_date("datetime").alias("date")).distinct().withColumns(
        {"installed_capacity": F.lit(2.0), "eic_count": F.lit(4.0)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = pipeline.build_features(spark, p.drop("target"), p, client, wx, fw, st)
        plan = _plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "SortMergeJoin" in x and "_c#" in x]
    assert len(joins) == 5
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(_c#" in x]
    assert len(dealt) == 1 + 5, dealt  # the items and each source
    assert "Exchange" not in plan[: plan.index(joins[0])]
    rows = out.collect()
    assert len(rows) == p.count()
    late = next(r for r in rows if r.row_id == 4 * 24 * 39)
    want = {r.row_id: r.target for r in p.collect()}
    assert late.target_48h == want[4 * 24 * 37]


def test_worst_groups_makes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    df = _panel(spark, 10).withColumn("p", F.udf(look, "double")("target") + F.col("county"))
    _, rows = M.worst_groups(df, ["county"], "p", "target", 0.5)
    assert {r.county for r in rows.collect()} == {1}
    assert seen.value == 40


def test_seeds_make_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    rows = _panel(spark, 50).withColumn("y", F.udf(look, "double")("target"))
    models = MD.fit_gbt_ensemble(rows, ["county", "row_id"], "y", (0, 1), {"maxIter": 1, "maxDepth": 2, "minInstancesPerNode": 1})
    assert [m.stages[1].getOrDefault("seed") for m in models] == [0, 1]
    assert seen.value <= 2 * 200  # two seeds may both ask before the rows are kept


def test_given_fog_is_read(spark):
    df = spark.createDataFrame([(10.0, 8.0, 500.0, 0.0, 0.0, 3.0, 2.0)], "temperature double, dewpoint double, sr double, s double, r double, w double, c double")
    reg = {"temperature": "temperature", "dewpoint": "dewpoint", "shortwave_radiation": "sr", "snowfall": "s", "rain": "r", "windspeed_10m": "w", "installed_capacity": "c"}
    made = df.withColumn("fog", SO.S.fog_intensity(F.col("temperature"), F.col("dewpoint"), F.col("w")))
    a = made.select(SO.solar_output(SO.DEFAULT_WEIGHTS, reg)).first()[0]
    b = made.select(SO.solar_output(SO.DEFAULT_WEIGHTS, {**reg, "fog": "fog"})).first()[0]
    assert a == b
