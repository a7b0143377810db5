"""Spatial queries: distance join, weights, land filter, point in polygon, county means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo as GEO
from ..session import bounded_broadcast
from ..sources import fixtures as fx
from .registry import query

_R = GEO.EARTH_RADIUS_KM


def _hav(lat1, lon1, lat2, lon2):
    return (f"2 * {_R} * asin(sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))")


@query("stations_within_km", f"""
SELECT c.county, CAST(s.longitude AS FLOAT) AS longitude, CAST(s.latitude AS FLOAT) AS latitude,
  {_hav('c.longitude', 'c.latitude', 's.longitude', 's.latitude')} AS dist
FROM capitals c CROSS JOIN stations s
WHERE {_hav('c.longitude', 'c.latitude', 's.longitude', 's.latitude')} < 100""", ("capitals", "stations"))
def stations_within_km(spark, sf):
    """Reference parity: 100 km, coordinates handed over as (lon, lat)."""
    return GEO.stations_within_km(fx.capitals(spark, sf), fx.stations(spark, sf), max_km=100.0, swap_axes=True)


@query("station_weights", "SELECT * FROM station_weights", ("station_weights",))
def station_weights(spark, sf):
    return fx.station_weights(spark, sf)


@query("station_unknown_weights", """
SELECT * FROM station_weights
UNION ALL
SELECT CAST(12 AS BIGINT) AS county, longitude, latitude, 0.0 AS dist, 1.0 / count(*) OVER () AS weights
FROM (SELECT DISTINCT longitude, latitude FROM station_weights)""", ("station_weights",))
def station_unknown_weights(spark, sf):
    w = fx.station_weights(spark, sf)
    return w.unionByName(GEO.unknown_county_weights(w))


_LAND = "SELECT DISTINCT round(latitude, 1) AS lat_cell, round(longitude, 1) AS lon_cell FROM hist_weather WHERE latitude <= 58.5"


@query("land_semi_join", f"""
WITH land AS ({_LAND})
SELECT s.* FROM station_weights s
WHERE EXISTS (SELECT 1 FROM land l WHERE l.lat_cell = round(CAST(s.latitude AS DOUBLE), 1)
  AND l.lon_cell = round(CAST(s.longitude AS DOUBLE), 1))""", ("station_weights", "hist_weather"))
def land_semi_join(spark, sf):
    hw = fx.hist_weather(spark, sf).filter(F.col("latitude") <= 58.5)
    land = hw.select(F.round("latitude", 1).alias("lat_cell"), F.round("longitude", 1).alias("lon_cell")).distinct()
    return GEO.land_semi_join(fx.station_weights(spark, sf), land)


_PIP_CTE = """hits AS (SELECT s.longitude, s.latitude, e.county, count(*) AS n FROM stations s, county_edges e
  WHERE ((e.y1 > s.latitude) != (e.y2 > s.latitude))
    AND s.longitude < (e.x2 - e.x1) * (s.latitude - e.y1) / (e.y2 - e.y1) + e.x1
  GROUP BY s.longitude, s.latitude, e.county),
ins AS (SELECT longitude, latitude, min(county) AS county, count(*) AS n_regions FROM hits WHERE n % 2 = 1
  GROUP BY longitude, latitude),
pip AS (SELECT s.longitude, s.latitude, i.county, coalesce(i.n_regions, 0) AS n_regions
  FROM stations s LEFT JOIN ins i USING (longitude, latitude))"""


def _pip(spark, sf):
    return GEO.point_in_polygon(fx.stations(spark, sf), fx.county_edges(spark, sf), band=0.1)


@query("point_in_polygon", f"WITH {_PIP_CTE} SELECT * FROM pip", ("stations", "county_edges"))
def point_in_polygon(spark, sf):
    return _pip(spark, sf)


@query("naive_county_weather", f"""
WITH {_PIP_CTE}
SELECT p.county, h.datetime, avg(h.temperature) AS temperature, avg(h.rain) AS rain,
  avg(h.shortwave_radiation) AS shortwave_radiation
FROM hist_weather h JOIN pip p USING (latitude, longitude) WHERE p.county IS NOT NULL
GROUP BY p.county, h.datetime""", ("stations", "county_edges", "hist_weather"))
def naive_county_weather(spark, sf):
    return GEO.naive_county_weather(fx.hist_weather(spark, sf), _pip(spark, sf),
                                    ["temperature", "rain", "shortwave_radiation"])


@query("weighted_mean_county", """
WITH hw AS (SELECT datetime, CAST(latitude AS FLOAT) AS latitude, CAST(longitude AS FLOAT) AS longitude,
  CASE WHEN rain > 0 THEN temperature END AS temperature FROM hist_weather)
SELECT datetime, county, sum(temperature * weights) / sum(CASE WHEN temperature IS NOT NULL THEN weights END) AS temperature
FROM hw JOIN station_weights USING (latitude, longitude) GROUP BY datetime, county""",
       ("hist_weather", "station_weights"))
def weighted_mean_county(spark, sf):
    """Renormalised weighted mean (temperature kept only where it rained, so some are missing)."""
    hw = fx.hist_weather(spark, sf).select(
        "datetime", F.col("latitude").cast("float").alias("latitude"), F.col("longitude").cast("float").alias("longitude"),
        F.when(F.col("rain") > 0, F.col("temperature")).alias("temperature"))
    st = fx.station_weights(spark, sf).select("latitude", "longitude", "county", "weights")
    j = hw.join(bounded_broadcast(st, 1_000_000), ["latitude", "longitude"], "inner")
    return GEO.weighted_mean_by(j, ["datetime", "county"], "temperature", "weights")
