"""County weather of the feature table is made from the stations' rows where it is packed, not stored or shuffled."""

import datetime as dt
import re

from pyspark.sql import functions as F

from wattpanel.operators import geo as G
from wattpanel.operators import lags as L
from wattpanel.plans import features as FT
from wattpanel.plans import pipeline

STATIONS = [(c, 1.0 + k, 2.0, 0.25 * (k + 1)) for c in range(2) for k in range(3)]


def _panel(spark, hours=24 * 40):
    t0 = F.lit(dt.datetime(2024, 1, 1))
    return spark.range(hours * 4).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("county"), (F.col("id") % 4 > 1).cast("long").alias("is_business"),
        (F.col("id") % 3).alias("product_type"), (F.col("id") % 2).cast("int").alias("is_consumption"),
        (t0 + F.make_dt_interval(F.lit(0), F.floor(F.col("id") / 4).cast("int"))).alias("datetime"), (F.col("id") * 7 % 101).cast("double").alias("target"))


def _weather(p):
    at = p.select("datetime").distinct().crossJoin(p.sparkSession.createDataFrame([(1.0 + k, 2.0, float(k)) for k in range(3)], "latitude double, longitude double, k double"))
    at = at.unionByName(at.limit(1).withColumn("datetime", F.lit(None).cast("timestamp")))
    h = F.coalesce(F.hour("datetime"), F.lit(0)).cast("double")
    return at.select("datetime", "latitude", "longitude", (h + F.col("k")).alias("temperature"), F.lit(1.0).alias("dewpoint"),
                     F.when(F.col("k") > 0, F.lit(0.25)).alias("rain"), F.lit(0.2).alias("snowfall"), F.lit(3.0).alias("windspeed_10m"), F.lit(90.0).alias("winddirection_10m"))


def test_rows_made_after_dealing_are_those_made_before(spark):
    p, st = _panel(spark, 24 * 9), spark.createDataFrame(STATIONS, "county long, latitude double, longitude double, weights double")
    w = _weather(p)
    prepare = FT.prepare_hist_weather
    source = FT.station_source(w, st, prepare, "historical", [0, 24, 48])
    cols = prepare(w)[1]
    county = FT.weather_source(G.weather_to_county(prepare(w)[0], st, cols), cols, "historical", [0, 24, 48])
    other = L.LagSource(p.groupBy("is_business", "datetime").agg(F.sum("target").alias("t")), ["is_business"], ["t"], [24])
    items = p.drop("target")
    got, want = (L.lag_joins(items, [s, other], "datetime").orderBy("row_id").collect() for s in (source, county))
    assert got == want and got[-1].rain_historical_h48 == 0.25 * 0.5 + 0.25 * 0.75
    chunks = L.lag_joins(items, [county], "datetime")
    assert L.lag_joins(items, [source], "datetime", strategy="pivot").select(*chunks.columns).orderBy("row_id").collect() == chunks.orderBy("row_id").collect()


def test_feature_table_deals_station_rows(spark):
    p, st = _panel(spark), spark.createDataFrame(STATIONS, "county long, latitude double, longitude double, weights double")
    w = _weather(p)
    fw = w.filter("datetime is not null").select(
        "latitude", "longitude", F.col("datetime").alias("origin_datetime"), F.lit(24).alias("hours_ahead"), "temperature", "dewpoint",
        F.lit(0.1).alias("total_precipitation"), F.lit(0.0).alias("snowfall"), F.lit(1.0).alias("10_metre_u_wind_component"),
        F.lit(1.0).alias("10_metre_v_wind_component"), F.lit(2.0).alias("surface_solar_radiation_downwards"))
    client = p.select("county", "is_business", "product_type", F.to_date("datetime").alias("date")).distinct().withColumns(
        {"installed_capacity": F.lit(2.0), "eic_count": F.lit(4.0)})
    out = pipeline.build_features(spark, p.drop("target"), p, client, w, fw, st)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # both weathers become rows of counties above the exchange that deals them
    assert len(re.findall(r"HashAggregate\(keys=\[_c#\d+L, _r#\d+L, datetime#\d+, county#\d+L\]", plan)) >= 2
    last = out.filter("row_id = 3836").first()  # hour 959
    assert last.temperature_historical == sum((959 % 24 + k) * 0.25 * (k + 1) for k in range(3))
    assert last.rain_historical_h48 == 0.3125 and last.rain_integrated_168h_historical == 168 * 0.3125
    assert last.surface_solar_radiation_downwards_forecast_h24 == 2.0 * 1.5 and out.count() == p.count()
