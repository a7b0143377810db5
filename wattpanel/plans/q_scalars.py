"""Queries for scalar functions, projections, filters and simple cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.holidays import EASTER_OFFSETS, FIXED_HOLIDAYS, add_holiday_flag
from ..operators import clean as C
from ..operators import lags as L
from ..operators.windows import ffill_limit
from ..session import bounded_broadcast
from ..sources import fixtures as fx
from ..sources.io import read_table
from . import features as FT
from .registry import query

SEG = FT.SEGMENT


@query("calendar_features", """
SELECT row_id, datetime, CAST(dayofyear(datetime) AS INTEGER) AS dayofyear, CAST(hour(datetime) AS INTEGER) AS hour,
  CAST(day(datetime) AS INTEGER) AS day, CAST(isodow(datetime) AS INTEGER) AS weekday,
  CAST(month(datetime) AS INTEGER) AS month, CAST(year(datetime) AS INTEGER) AS year
FROM panel""", ("panel",))
def calendar_features(spark, sf):
    return fx.panel(spark, sf).select("row_id", "datetime", *[v.alias(k) for k, v in S.calendar_columns().items()])


@query("cyclic_features", """
SELECT row_id, sin(pi() * dayofyear(datetime) / 183) AS "sin(dayofyear)", cos(pi() * dayofyear(datetime) / 183) AS "cos(dayofyear)",
  sin(pi() * hour(datetime) / 12) AS "sin(hour)", cos(pi() * hour(datetime) / 12) AS "cos(hour)"
FROM panel""", ("panel",))
def cyclic_features(spark, sf):
    df = fx.panel(spark, sf).withColumns(S.calendar_columns())
    return df.select("row_id", *[v.alias(k) for k, v in S.cyclic_columns().items()])


@query("segment_key", """
SELECT row_id, CAST(CASE WHEN row_id % 10 = 0 THEN NULL ELSE county END AS VARCHAR) || '_' || CAST(is_business AS VARCHAR)
  || '_' || CAST(product_type AS VARCHAR) || '_' || CAST(is_consumption AS VARCHAR) AS segment
FROM panel""", ("panel",))
def segment_key(spark, sf):
    p = fx.panel(spark, sf).withColumn("county", F.when(F.col("row_id") % 10 != 0, F.col("county")))
    return p.select("row_id", S.segment_key(SEG).alias("segment"))


_HUM = "100 * (exp(17.625 * dewpoint / (243.04 + dewpoint)) / exp(17.625 * temperature / (243.04 + temperature)))"


@query("humidity", f"SELECT datetime, latitude, longitude, {_HUM} AS humidity FROM hist_weather", ("hist_weather",))
def humidity(spark, sf):
    return fx.hist_weather(spark, sf).select("datetime", "latitude", "longitude",
                                             S.relative_humidity("temperature", "dewpoint").alias("humidity"))


@query("fog_intensity", f"""
SELECT datetime, latitude, longitude,
  {_HUM} * (CASE WHEN windspeed_10m < 2.0 THEN 1.0 ELSE 1.0 / windspeed_10m END) / 100 AS fog
FROM hist_weather""", ("hist_weather",))
def fog_intensity(spark, sf):
    return fx.hist_weather(spark, sf).select(
        "datetime", "latitude", "longitude", S.fog_intensity("temperature", "dewpoint", "windspeed_10m").alias("fog"))


@query("wind_uv", """
SELECT datetime, latitude, longitude,
  windspeed_10m * cos(winddirection_10m * (180 / pi())) AS u, windspeed_10m * sin(winddirection_10m * (180 / pi())) AS v,
  windspeed_10m * cos(winddirection_10m * (pi() / 180)) AS u_rad, windspeed_10m * sin(winddirection_10m * (pi() / 180)) AS v_rad
FROM hist_weather""", ("hist_weather",))
def wind_uv(spark, sf):
    u, v = S.wind_uv("windspeed_10m", "winddirection_10m", "reference")
    ur, vr = S.wind_uv("windspeed_10m", "winddirection_10m", "radians")
    return fx.hist_weather(spark, sf).select("datetime", "latitude", "longitude", u.alias("u"), v.alias("v"),
                                             ur.alias("u_rad"), vr.alias("v_rad"))


@query("wind_speed", """
SELECT latitude, longitude, origin_datetime, hours_ahead, sqrt(v10 * v10 + u10 * u10) AS windspeed_10m
FROM forecast_weather""", ("forecast_weather",))
def wind_speed(spark, sf):
    return fx.forecast_weather(spark, sf).select("latitude", "longitude", "origin_datetime", "hours_ahead",
                                                 S.wind_speed("u10", "v10").alias("windspeed_10m"))


@query("precip_convert", """
SELECT latitude, longitude, origin_datetime, hours_ahead,
  CASE WHEN total_precipitation - snowfall < 0 THEN 0.0 ELSE total_precipitation - snowfall END * 1000 AS rain,
  snowfall * 424.24 AS snowfall
FROM forecast_weather""", ("forecast_weather",))
def precip_convert(spark, sf):
    f = fx.forecast_weather(spark, sf)
    return f.select("latitude", "longitude", "origin_datetime", "hours_ahead",
                    *[v.alias(k) for k, v in S.precipitation_columns().items()])


@query("forecast_valid_time", """
SELECT latitude, longitude, origin_datetime, hours_ahead, origin_datetime + to_hours(hours_ahead) AS datetime
FROM forecast_weather""", ("forecast_weather",))
def forecast_valid_time(spark, sf):
    f = fx.forecast_weather(spark, sf)
    return f.select("latitude", "longitude", "origin_datetime", "hours_ahead",
                    S.forecast_valid_time().alias("datetime"))


@query("clip_floor", """
SELECT datetime, latitude, longitude, CASE WHEN temperature < 0 THEN 0.0 ELSE temperature END AS temperature,
  CASE WHEN dewpoint < 0 THEN 0.0 ELSE dewpoint END AS dewpoint
FROM hist_weather""", ("hist_weather",))
def clip_floor(spark, sf):
    h = fx.hist_weather(spark, sf)
    return h.select("datetime", "latitude", "longitude", S.clip_floor("temperature").alias("temperature"),
                    S.clip_floor("dewpoint").alias("dewpoint"))


@query("product_name", """
SELECT row_id, product_type, CASE product_type WHEN 0 THEN 'Combined' WHEN 1 THEN 'Fixed'
  WHEN 2 THEN 'General service' WHEN 3 THEN 'Spot' END AS product_name
FROM panel""", ("panel",))
def product_name(spark, sf):
    return fx.panel(spark, sf).select("row_id", "product_type", S.product_name("product_type").alias("product_name"))


_RAW_NAME = "CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, ' ', '-')) ELSE replace(n_name, ' ', '-') END"


@query("format_name", f"""
SELECT n_nationkey, array_to_string(list_transform(string_split({_RAW_NAME}, '-'),
  lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '-') AS county_name
FROM nation""")
def format_name(spark, sf):
    n = read_table(spark, sf, "nation")
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.lower(F.regexp_replace("n_name", " ", "-"))).otherwise(
        F.regexp_replace("n_name", " ", "-"))
    return n.select("n_nationkey", S.format_name(raw).alias("county_name"))


@query("name_to_id", f"""
WITH dim AS (SELECT n_nationkey AS county, array_to_string(list_transform(string_split(replace(n_name, ' ', '-'), '-'),
    lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '-') AS county_name FROM nation),
lookup AS (SELECT n_nationkey AS k, array_to_string(list_transform(string_split({_RAW_NAME}, '-'),
    lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '-') AS name FROM nation)
SELECT l.k, l.name, d.county FROM lookup l LEFT JOIN dim d ON d.county_name = l.name""")
def name_to_id(spark, sf):
    n = read_table(spark, sf, "nation")
    dim = n.select(
        F.col("n_nationkey").alias("county"), S.format_name(F.regexp_replace("n_name", " ", "-")).alias("county_name"))
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.lower(F.regexp_replace("n_name", " ", "-"))).otherwise(
        F.regexp_replace("n_name", " ", "-"))
    lookup = n.select(F.col("n_nationkey").alias("k"), S.format_name(raw).alias("name"))
    return C.name_to_id(lookup, dim, "name").select("k", "name", "county")


# Holiday SQL: the same fixed dates and Easter offsets, Easter by the computus in integer SQL.
def _holiday_sql(first: int, last: int) -> str:
    fixed = " UNION ALL ".join(f"SELECT make_date(y, {m}, {d}) AS date FROM yrs" for m, d in FIXED_HOLIDAYS)
    moving = " UNION ALL ".join(f"SELECT easter + INTERVAL ({o}) DAY AS date FROM e" for o in EASTER_OFFSETS)
    return f"""yrs AS (SELECT CAST(range AS INTEGER) AS y FROM range({first}, {last + 1})),
c AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS cc FROM yrs),
c2 AS (SELECT y, a, b, cc, b // 4 AS d, b % 4 AS e, (b + 8) // 25 AS f FROM c),
c3 AS (SELECT *, (b - f + 1) // 3 AS g FROM c2),
c4 AS (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, cc // 4 AS i, cc % 4 AS k FROM c3),
c5 AS (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM c4),
c6 AS (SELECT *, (a + 11 * h + 22 * l) // 451 AS m FROM c5),
e AS (SELECT make_date(y, CAST((h + l - 7 * m + 114) // 31 AS INTEGER), CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) AS easter FROM c6),
hol AS (SELECT DISTINCT CAST(date AS DATE) AS date FROM ({fixed} UNION ALL {moving}))"""


@query("holiday_flag", f"""
WITH {_holiday_sql(2021, 2025)}
SELECT p.row_id, CAST(CAST(p.datetime AS DATE) AS TIMESTAMP) AS date, (h.date IS NOT NULL) AS is_country_holiday
FROM panel p LEFT JOIN hol h ON h.date = CAST(p.datetime AS DATE)""", ("panel",))
def holiday_flag(spark, sf):
    p = FT.with_date(fx.panel(spark, sf))
    return add_holiday_flag(p).select("row_id", F.col("date").cast("timestamp").alias("date"), "is_country_holiday")


@query("holiday_calendar", f"""
WITH {_holiday_sql(1992, 2001)}, d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT CAST(d.date AS TIMESTAMP) AS date, (h.date IS NOT NULL) AS is_country_holiday FROM d LEFT JOIN hol h ON h.date = d.date""")
def holiday_calendar(spark, sf):
    d = read_table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return add_holiday_flag(d, "date").select(F.col("date").cast("timestamp").alias("date"),
                                                          "is_country_holiday")


@query("downcast_float", """
SELECT datetime, latitude::FLOAT AS latitude, longitude::FLOAT AS longitude, temperature::FLOAT AS temperature,
  dewpoint::FLOAT AS dewpoint, rain::FLOAT AS rain, snowfall::FLOAT AS snowfall, windspeed_10m::FLOAT AS windspeed_10m,
  winddirection_10m::FLOAT AS winddirection_10m, shortwave_radiation::FLOAT AS shortwave_radiation
FROM hist_weather""", ("hist_weather",))
def downcast_float(spark, sf):
    return S.downcast_floats(fx.hist_weather(spark, sf))


@query("swap_hist_forecast", """
SELECT datetime, latitude, longitude, dewpoint AS temperature_historical, snowfall AS snowfall_historical_h48,
  windspeed_10m AS windspeed_10m_forecast
FROM hist_weather""", ("hist_weather",))
def swap_hist_forecast(spark, sf):
    h = fx.hist_weather(spark, sf).select(
        "datetime", "latitude", "longitude",
        F.col("temperature").alias("temperature_historical"), F.col("dewpoint").alias("temperature_forecast"),
        F.col("rain").alias("rain_historical"), F.col("snowfall").alias("snowfall_historical_h48"),
        F.col("windspeed_10m").alias("windspeed_10m_forecast"))
    return S.swap_hist_forecast(h)


@query("dropna_any", """
SELECT p.row_id, o48.target AS target_48h, o72.target AS target_72h
FROM panel p
LEFT JOIN panel o48 ON o48.county = p.county AND o48.is_business = p.is_business AND o48.product_type = p.product_type
  AND o48.is_consumption = p.is_consumption AND o48.datetime + INTERVAL 48 HOUR = p.datetime
LEFT JOIN panel o72 ON o72.county = p.county AND o72.is_business = p.is_business AND o72.product_type = p.product_type
  AND o72.is_consumption = p.is_consumption AND o72.datetime + INTERVAL 72 HOUR = p.datetime
WHERE o48.target IS NOT NULL AND o72.target IS NOT NULL AND NOT isnan(o48.target) AND NOT isnan(o72.target)""",
       ("panel",))
def dropna_any(spark, sf):
    p = fx.panel(spark, sf)
    df = L.lag_join(p.select("row_id", *SEG, "datetime"), p.select(*SEG, "datetime", "target"), SEG, "datetime",
                    ["target"], [48, 72])
    return C.dropna_any(df.select("row_id", "target_48h", "target_72h"))


@query("route_split", """
SELECT row_id, county, is_business, product_type, datetime, target FROM panel WHERE is_consumption = 0""", ("panel",))
def route_split(spark, sf):
    return fx.panel(spark, sf).filter(F.col("is_consumption") == 0).drop("is_consumption")


# Stand-in nulls for the clock-change gaps: target missing where row_id % 7 = 0.
_NULLED = "SELECT * REPLACE (CASE WHEN row_id % 7 = 0 THEN NULL ELSE target END AS target) FROM panel"


def _nulled(spark, sf):
    p = fx.panel(spark, sf)
    return p.withColumn("target", F.when(F.col("row_id") % 7 != 0, F.col("target")))


_FFILL1 = ("coalesce(target, lag(target) OVER (PARTITION BY county, is_business, product_type, is_consumption "
           "ORDER BY datetime))")


@query("ffill_limit", f"""
WITH n AS ({_NULLED}) SELECT row_id, datetime, county, is_business, product_type, is_consumption, {_FFILL1} AS target
FROM n""", ("panel",))
def ffill_limit_q(spark, sf):
    return ffill_limit(_nulled(spark, sf), SEG, "datetime", "target", passes=1).select(
        "row_id", "datetime", *SEG, "target")


@query("ffill_limit_twice", f"""
WITH n AS ({_NULLED}), a AS (SELECT * REPLACE ({_FFILL1} AS target) FROM n)
SELECT row_id, datetime, county, is_business, product_type, is_consumption, {_FFILL1} AS target FROM a""", ("panel",))
def ffill_limit_twice(spark, sf):
    return ffill_limit(_nulled(spark, sf), SEG, "datetime", "target", passes=2).select(
        "row_id", "datetime", *SEG, "target")


@query("time_floor", f"""
WITH n AS ({_NULLED}), a AS (SELECT * REPLACE ({_FFILL1} AS target) FROM n)
SELECT * FROM a WHERE datetime >= TIMESTAMP '2024-01-15 00:00:00'""", ("panel",))
def time_floor(spark, sf):
    filled = ffill_limit(_nulled(spark, sf), SEG, "datetime", "target", passes=1)
    return C.time_floor(filled, "datetime", "2024-01-15 00:00:00")


_SCORED = "(hour(datetime) = 3 AND day(datetime) % 2 = 0)"


@query("batch_needed", f"""
SELECT CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS date, bool_or({_SCORED}) AS needed FROM panel GROUP BY 1""", ("panel",))
def batch_needed(spark, sf):
    p = fx.panel(spark, sf).withColumns({
        "date": F.to_date("datetime").cast("timestamp"),
        "currently_scored": (F.hour("datetime") == 3) & (F.dayofmonth("datetime") % 2 == 0)})
    return C.batch_needed(p, "currently_scored", ["date"])


# prediction = target, with a null where row_id % 22 = 0 and +inf where row_id % 22 = 11.
_PRED = ("CASE WHEN row_id % 22 = 0 THEN NULL WHEN row_id % 22 = 11 THEN CAST('inf' AS DOUBLE) "
         "ELSE target - 30 END")


@query("prediction_guard", f"""
WITH b AS (SELECT row_id, CAST(CAST(datetime AS DATE) AS TIMESTAMP) AS date, {_PRED} AS pred, {_SCORED} AS scored FROM panel),
g AS (SELECT date, bool_or(scored) AS needed, bool_or(pred IS NULL OR isnan(pred)) AS has_nan,
  bool_or(isinf(pred)) AS has_inf FROM b GROUP BY date)
SELECT b.row_id, b.date, CASE WHEN NOT g.needed THEN 0.0 WHEN g.has_nan THEN 44444444.0 WHEN g.has_inf THEN 99999999.0
  WHEN b.pred < 0 THEN 0.0 ELSE b.pred END AS target
FROM b JOIN g USING (date)""", ("panel",))
def prediction_guard(spark, sf):
    from ..streaming.feeds import guard_predictions

    p = fx.panel(spark, sf)
    pred = (F.when(F.col("row_id") % 22 == 0, F.lit(None).cast("double"))
            .when(F.col("row_id") % 22 == 11, F.lit(float("inf"))).otherwise(F.col("target") - 30))
    b = p.select("row_id", F.to_date("datetime").cast("timestamp").alias("date"), pred.alias("pred"),
                 ((F.hour("datetime") == 3) & (F.dayofmonth("datetime") % 2 == 0)).alias("scored"))
    return guard_predictions(b, "pred", "scored", ["date"]).select("row_id", "date", "target")



# --- C13: train x client merge on six keys, clashing client columns suffixed ---------------------------
_CN_SQL = ("SELECT CAST(n_nationkey AS BIGINT) AS county, array_to_string(list_transform(string_split("
           "replace(n_name, ' ', '-'), '-'), lambda p: upper(left(p, 1)) || lower(substring(p, 2))), '-') "
           "AS county_name FROM nation")
_PN_SQL = ("CASE product_type WHEN 0 THEN 'Combined' WHEN 1 THEN 'Fixed' WHEN 2 THEN 'General service' "
           "WHEN 3 THEN 'Spot' END")


@query("train_client_merge", f"""
WITH cn AS ({_CN_SQL}),
t AS (SELECT p.*, cn.county_name, {_PN_SQL} AS product_name, CAST(p.datetime AS DATE) AS date,
  CAST(day(p.datetime) AS INTEGER) AS data_block_id FROM panel p LEFT JOIN cn USING (county)),
c AS (SELECT c.*, cn.county_name, {_PN_SQL} AS product_name, CAST(day(c.date) AS INTEGER) + 2 AS data_block_id
  FROM client c LEFT JOIN cn USING (county))
SELECT t.* EXCLUDE (date), c.eic_count, c.installed_capacity, c.data_block_id AS data_block_id_client
FROM t LEFT JOIN c ON c.county = t.county AND c.product_type = t.product_type AND c.is_business = t.is_business
  AND c.county_name = t.county_name AND c.product_name = t.product_name AND c.date = t.date""", ("panel", "client"))
def train_client_merge(spark, sf):
    from .models import merge_with_suffix

    n = read_table(spark, sf, "nation")
    names = n.select(F.col("n_nationkey").cast("long").alias("county"),
                     S.format_name(F.regexp_replace("n_name", " ", "-")).alias("county_name"))
    t = fx.panel(spark, sf).join(bounded_broadcast(names), "county", "left").withColumns({
        "product_name": S.product_name("product_type"), "date": F.to_date("datetime"),
        "data_block_id": F.dayofmonth("datetime")})
    c = fx.client(spark, sf).join(bounded_broadcast(names), "county", "left").withColumns({
        "product_name": S.product_name("product_type"), "data_block_id": F.dayofmonth("date") + 2})
    keys = ["county", "product_type", "is_business", "county_name", "product_name", "date"]
    return merge_with_suffix(t, c, keys).drop("date")
