"""Stand-in frames for the energy tables, derived by Spark from the test tables.

The reference reads private CSVs (target, client, weather, capitals, ...).  The
test data are TPC-H-like tables plus ``events``; the frames below turn those into
tables with the same shape so that every operator runs over data whose size grows
with the input: each further ``BLOCK_USERS`` users play a further 30 days of the panel, with
weather points of their own between the first ones, so hours, points and rows all grow with the
users of ``events``.  Counties are the nations.  ``FIXTURE_SQL`` holds the same definitions as
DuckDB SQL for the oracle side; both were written to agree row for row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .io import read_table

EARTH_RADIUS_KM = 6371.0088
BLOCK_USERS = 150  # users that share 30 days
COUNTIES = 25  # rows of nation
POINTS = 30  # weather points of one block


def _block():
    return F.expr(f"user_id div {BLOCK_USERS}")


def _time():
    """When a user's event happens in the panel: each block of users has its own 30 days."""
    return F.expr(f"ts + make_dt_interval(cast(30 * (user_id div {BLOCK_USERS}) as int))")


def _with_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("ts", _time())


def _county_keys():
    uid = F.col("user_id")
    return [
        (uid % COUNTIES).alias("county"),
        (F.expr("user_id div 15") % 2).alias("is_business"),
        (uid % 4).alias("product_type"),
    ]


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly target per segment (plays ``train.csv``)."""
    ev = _with_time(spark, sf_dir)
    return ev.groupBy(
        *_county_keys(),
        F.when(F.col("event_type").isin("view", "click"), 1).otherwise(0).alias("is_consumption"),
        F.date_trunc("hour", "ts").alias("datetime"),
    ).agg(F.round(F.sum("value"), 4).alias("target"), F.min("event_id").alias("row_id"))


def client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily client table (eic_count, installed_capacity) per county/business/product."""
    ev = _with_time(spark, sf_dir)
    return ev.groupBy(*_county_keys(), F.col("ts").cast("date").alias("date")).agg(
        F.countDistinct("user_id").cast("double").alias("eic_count"),
        F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 4).alias(
            "installed_capacity"
        ),
    )


def _grid_point():
    """Points of the first block lie on a diagonal; those of later blocks a few hundredths of a degree beside them."""
    k = f"cast(user_id % {POINTS} as int)"
    lat = F.expr(f"cast((57600 + 100 * {k} + cast((user_id div {BLOCK_USERS}) % 100 as int)) / 1000.0D as double)")
    lon = F.expr(f"cast((21800 + 300 * {k} + cast((user_id div {100 * BLOCK_USERS}) % 300 as int)) / 1000.0D as double)")
    return lat, lon


def hist_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly observed weather per grid point (plays ``historical_weather.csv``)."""
    ev = _with_time(spark, sf_dir)
    lat, lon = _grid_point()
    return ev.groupBy(
        F.date_trunc("hour", "ts").alias("datetime"), lat.alias("latitude"), lon.alias("longitude")
    ).agg(
        F.round(F.max("value") / 10 - 5, 4).alias("temperature"),
        F.round(F.max("value") / 10 - 7, 4).alias("dewpoint"),
        F.round(F.sum(F.when(F.col("event_type") == "error", F.col("value")).otherwise(0.0)) / 100, 6).alias("rain"),
        F.round(F.sum(F.when(F.col("event_type") == "signup", F.col("value")).otherwise(0.0)) / 1000, 6).alias(
            "snowfall"
        ),
        F.round(F.min("value") / 10, 4).alias("windspeed_10m"),
        (F.min("event_id") % 360).cast("double").alias("winddirection_10m"),
        F.round(F.sum("value"), 4).alias("shortwave_radiation"),
    )


def forecast_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast issues per grid point (plays ``forecast_weather.csv``; u10/v10 are the wind parts)."""
    ev = _with_time(spark, sf_dir)
    lat, lon = _grid_point()
    return ev.groupBy(
        lat.alias("latitude"),
        lon.alias("longitude"),
        F.date_trunc("day", "ts").alias("origin_datetime"),
        (F.lit(1) + F.col("event_id") % 48).cast("int").alias("hours_ahead"),
    ).agg(
        F.round(F.max("value") / 10 - 5, 4).alias("temperature"),
        F.round(F.max("value") / 10 - 7, 4).alias("dewpoint"),
        F.round(F.sum("value") / 100000, 9).alias("total_precipitation"),
        F.round(F.min("value") / 1000000, 9).alias("snowfall"),
        F.round(F.max("value") / 10 - 5, 4).alias("u10"),
        F.round(F.min("value") / 10 - 5, 4).alias("v10"),
        F.round(F.sum("value"), 4).alias("surface_solar_radiation_downwards"),
    )


def capitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capital per nation with coordinates."""
    n = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    k = F.col("k")
    return n.select(
        k.alias("county"),
        F.round(F.lit(57.65).cast("decimal(4,2)") + F.lit(0.12).cast("decimal(3,2)") * k, 2)
        .cast("double")
        .alias("latitude"),
        F.round(F.lit(22.0).cast("decimal(3,1)") + F.lit(0.4).cast("decimal(2,1)") * k, 2)
        .cast("double")
        .alias("longitude"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_weather(spark, sf_dir).select("latitude", "longitude").distinct()


def station_weights(spark: SparkSession, sf_dir: str, max_km: float = 150.0) -> DataFrame:
    """Stations within ``max_km`` of each capital (true axes, haversine) and their weights; made once, as jobs read it several times."""
    from ..operators.geo import distance_weights, stations_within_km

    near = stations_within_km(
        capitals(spark, sf_dir), stations(spark, sf_dir), max_km=max_km, swap_axes=False
    )
    return cut_lineage(distance_weights(near))


# One unit box around each capital, as four directed edges.
BOX_EDGES = [
    (0, -0.2, -0.06, 0.2, -0.06),
    (1, 0.2, -0.06, 0.2, 0.06),
    (2, 0.2, 0.06, -0.2, 0.06),
    (3, -0.2, 0.06, -0.2, -0.06),
]


def county_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """County boundaries as edge rows (one box per county)."""
    edges = F.array(
        *[
            F.struct(F.lit(e).alias("e"), F.lit(dx1).alias("dx1"), F.lit(dy1).alias("dy1"),
                     F.lit(dx2).alias("dx2"), F.lit(dy2).alias("dy2"))
            for e, dx1, dy1, dx2, dy2 in BOX_EDGES
        ]
    )
    c = capitals(spark, sf_dir).select("county", "latitude", "longitude", F.explode(edges).alias("v"))
    return c.select(
        "county",
        F.col("v.e").alias("e"),
        (F.col("longitude") + F.col("v.dx1")).alias("x1"),
        (F.col("latitude") + F.col("v.dy1")).alias("y1"),
        (F.col("longitude") + F.col("v.dx2")).alias("x2"),
        (F.col("latitude") + F.col("v.dy2")).alias("y2"),
    )


BUILDERS = {
    "panel": panel,
    "client": client,
    "hist_weather": hist_weather,
    "forecast_weather": forecast_weather,
    "capitals": capitals,
    "stations": stations,
    "station_weights": station_weights,
    "county_edges": county_edges,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf_dir)


# ---------------------------------------------------------------------------
# The same frames as DuckDB SQL (oracle side).  Order matters: later views use
# earlier ones.
_EVENTS = f"(SELECT * REPLACE (ts + to_days(CAST(30 * (user_id // {BLOCK_USERS}) AS INTEGER)) AS ts) FROM events)"
_LAT = f"(57600 + 100 * (user_id % {POINTS}) + (user_id // {BLOCK_USERS}) % 100) / 1000.0::DOUBLE"
_LON = f"(21800 + 300 * (user_id % {POINTS}) + (user_id // {100 * BLOCK_USERS}) % 300) / 1000.0::DOUBLE"
FIXTURE_SQL: dict[str, str] = {
    "panel": f"""
SELECT user_id % {COUNTIES} AS county, (user_id // 15) % 2 AS is_business, user_id % 4 AS product_type,
       CASE WHEN event_type IN ('view','click') THEN 1 ELSE 0 END AS is_consumption,
       date_trunc('hour', ts) AS datetime, round(sum(value), 4) AS target, min(event_id) AS row_id
FROM {_EVENTS} GROUP BY 1,2,3,4,5""",
    "client": f"""
SELECT user_id % {COUNTIES} AS county, (user_id // 15) % 2 AS is_business, user_id % 4 AS product_type,
       CAST(ts AS DATE) AS date, CAST(count(DISTINCT user_id) AS DOUBLE) AS eic_count,
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS installed_capacity
FROM {_EVENTS} GROUP BY 1,2,3,4""",
    "hist_weather": f"""
SELECT date_trunc('hour', ts) AS datetime, {_LAT} AS latitude,
       {_LON} AS longitude,
       round(max(value) / 10 - 5, 4) AS temperature, round(max(value) / 10 - 7, 4) AS dewpoint,
       round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / 100, 6) AS rain,
       round(sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) / 1000, 6) AS snowfall,
       round(min(value) / 10, 4) AS windspeed_10m, CAST(min(event_id) % 360 AS DOUBLE) AS winddirection_10m,
       round(sum(value), 4) AS shortwave_radiation
FROM {_EVENTS} GROUP BY 1,2,3""",
    "forecast_weather": f"""
SELECT {_LAT} AS latitude,
       {_LON} AS longitude,
       date_trunc('day', ts) AS origin_datetime, CAST(1 + event_id % 48 AS INT) AS hours_ahead,
       round(max(value) / 10 - 5, 4) AS temperature, round(max(value) / 10 - 7, 4) AS dewpoint,
       round(sum(value) / 100000, 9) AS total_precipitation, round(min(value) / 1000000, 9) AS snowfall,
       round(max(value) / 10 - 5, 4) AS u10, round(min(value) / 10 - 5, 4) AS v10,
       round(sum(value), 4) AS surface_solar_radiation_downwards
FROM {_EVENTS} GROUP BY 1,2,3,4""",
    "capitals": """
SELECT k AS county, CAST(round(57.65 + 0.12 * k, 2) AS DOUBLE) AS latitude,
       CAST(round(22.0 + 0.4 * k, 2) AS DOUBLE) AS longitude
FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)""",
    "stations": """
SELECT DISTINCT latitude, longitude FROM hist_weather""",
    "station_weights": """
WITH d AS (SELECT c.county, CAST(s.longitude AS FLOAT) AS longitude, CAST(s.latitude AS FLOAT) AS latitude,
    2 * 6371.0088 * asin(sqrt(power(sin(radians(s.latitude - c.latitude) / 2), 2)
      + cos(radians(c.latitude)) * cos(radians(s.latitude)) * power(sin(radians(s.longitude - c.longitude) / 2), 2))) AS dist
  FROM capitals c CROSS JOIN stations s)
SELECT *, dist / sum(dist) OVER (PARTITION BY county) AS weights FROM d WHERE dist < 150""",
    "county_edges": """
SELECT county, e, longitude + dx1 AS x1, latitude + dy1 AS y1, longitude + dx2 AS x2, latitude + dy2 AS y2
FROM capitals CROSS JOIN (VALUES (0,-0.2,-0.06,0.2,-0.06),(1,0.2,-0.06,0.2,0.06),(2,0.2,0.06,-0.2,0.06),(3,-0.2,0.06,-0.2,-0.06)) v(e,dx1,dy1,dx2,dy2)""",
}

_DEPS = {
    "stations": ["hist_weather"],
    "station_weights": ["capitals", "stations"],
    "county_edges": ["capitals"],
}


def with_fixtures(sql: str, *names: str) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named stand-in views (and their inputs)."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    body = sql.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in order)
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
