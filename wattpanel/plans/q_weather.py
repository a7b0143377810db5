"""Weather queries: station weighting, sliding sums, weather lags, differences, gap repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clean as C
from ..operators import lags as L
from ..operators.geo import weather_to_county
from ..operators.windows import Rolling, rolling_sums_time, sliding_sum
from ..sources import fixtures as fx
from . import features as FT
from . import sqlgen as G
from .registry import query

U, V = "10_metre_u_wind_component", "10_metre_v_wind_component"
_HUM = "100 * (exp(17.625 * dewpoint / (243.04 + dewpoint)) / exp(17.625 * temperature / (243.04 + temperature)))"
_FOG = f"{_HUM} * (CASE WHEN windspeed_10m < 2.0 THEN 1.0 ELSE 1.0 / windspeed_10m END) / 100"

HIST_COLS = ["temperature", "dewpoint", "rain", "snowfall", "windspeed_10m", "shortwave_radiation", U, V, "fog",
             "humidity"]
FC_COLS = ["temperature", "dewpoint", "total_precipitation", "snowfall", U, V, "surface_solar_radiation_downwards",
           "windspeed_10m", "rain", "fog", "humidity"]


def _wsum(cols):
    return ", ".join(f"sum({G.q(c)} * weights) AS {G.q(c)}" for c in cols)


HCW_CTE = f"""hw AS (SELECT datetime, CAST(latitude AS FLOAT) AS latitude, CAST(longitude AS FLOAT) AS longitude,
  temperature, dewpoint, rain, snowfall, windspeed_10m, shortwave_radiation,
  windspeed_10m * cos(winddirection_10m * (180 / pi())) AS "{U}",
  windspeed_10m * sin(winddirection_10m * (180 / pi())) AS "{V}",
  {_FOG} AS fog, {_HUM} AS humidity FROM hist_weather),
hcw AS (SELECT datetime, county, {_wsum(HIST_COLS)} FROM hw JOIN station_weights USING (latitude, longitude)
  GROUP BY datetime, county)"""

FCW_CTE = f"""fw0 AS (SELECT CAST(latitude AS FLOAT) AS latitude, CAST(longitude AS FLOAT) AS longitude,
  origin_datetime + to_hours(hours_ahead) AS datetime, temperature, dewpoint, u10 AS "{U}", v10 AS "{V}",
  surface_solar_radiation_downwards, total_precipitation,
  CASE WHEN total_precipitation - snowfall < 0 THEN 0.0 ELSE total_precipitation - snowfall END * 1000 AS rain,
  snowfall * 424.24 AS snowfall, sqrt(v10 * v10 + u10 * u10) AS windspeed_10m
  FROM forecast_weather WHERE hours_ahead >= 23),
fw AS (SELECT *, {_FOG} AS fog, {_HUM} AS humidity FROM fw0),
fcw AS (SELECT datetime, county, {_wsum(FC_COLS)} FROM fw JOIN station_weights USING (latitude, longitude)
  GROUP BY datetime, county)"""

WX_FIX = ("hist_weather", "forecast_weather", "station_weights")


def county_hist(spark, sf, stations_w=None):
    hw, cols = FT.prepare_hist_weather(fx.hist_weather(spark, sf))
    sw = stations_w if stations_w is not None else fx.station_weights(spark, sf)
    return weather_to_county(hw, sw, cols), cols


def _forecast_input(spark, sf):
    return fx.forecast_weather(spark, sf).withColumnsRenamed({"u10": U, "v10": V})


def county_forecast(spark, sf, stations_w=None):
    fw, cols = FT.prepare_forecast_weather(_forecast_input(spark, sf))
    sw = stations_w if stations_w is not None else fx.station_weights(spark, sf)
    return weather_to_county(fw, sw, cols), cols


@query("weather_to_county", f"WITH {HCW_CTE} SELECT * FROM hcw", WX_FIX)
def weather_to_county_q(spark, sf):
    return county_hist(spark, sf)[0]


@query("forecast_weather_county", f"WITH {FCW_CTE} SELECT * FROM fcw", WX_FIX)
def forecast_weather_county(spark, sf):
    return county_forecast(spark, sf)[0]


def _sliding_sql(src, col, days, out):
    return f"""SELECT county, date_trunc('day', datetime) + to_days(CAST(k AS INTEGER)) AS datetime, sum({col}) AS {out}
FROM {src}, range(1, {days + 1}) t(k) GROUP BY 1, 2"""


@query("sliding_sum_7d", f"WITH {HCW_CTE} {_sliding_sql('hcw', 'rain', 7, 'rain_integrated_168h_historical')}",
       WX_FIX)
def sliding_sum_7d(spark, sf):
    cw, _ = county_hist(spark, sf)
    return sliding_sum(cw, ["county"], "datetime", "rain", "7 days", "1 day", "rain_integrated_168h_historical")


@query("sliding_sum_2d", f"WITH {FCW_CTE} {_sliding_sql('fcw', 'snowfall', 2, 'snowfall_integrated_48h_forecast')}",
       WX_FIX)
def sliding_sum_2d(spark, sf):
    cw, _ = county_forecast(spark, sf)
    return sliding_sum(cw, ["county"], "datetime", "snowfall", "2 days", "1 day", "snowfall_integrated_48h_forecast")


def _name(c, kind, h):
    return f"{c}_{kind}" if h == 0 else f"{c}_{kind}_h{h}"


def _weather_lag_sql(cte, src, cols, kind, lags):
    joins = [G.lag_join("p", src, f"w{h}", ["county"], h) for h in lags]
    sel = [f"w{h}.{G.q(c)} AS {G.q(_name(c, kind, h))}" for h in lags for c in cols]
    return f"WITH {cte} SELECT {_ITEM}, {', '.join(sel)} FROM panel p {' '.join(joins)}"


_ITEM = ", ".join(f"p.{c}" for c in G.ITEM)


def _items(spark, sf):
    return fx.panel(spark, sf).drop("target")


@query("lag_weather_hist", _weather_lag_sql(HCW_CTE, "hcw", HIST_COLS, "historical", FT.WEATHER_LAGS),
       ("panel",) + WX_FIX)
def lag_weather_hist(spark, sf):
    cw, cols = county_hist(spark, sf)
    return FT.weather_family(_items(spark, sf), cw, cols, "historical")


@query("lag_weather_forecast", _weather_lag_sql(FCW_CTE, "fcw", FC_COLS, "forecast", FT.WEATHER_LAGS),
       ("panel",) + WX_FIX)
def lag_weather_forecast(spark, sf):
    cw, cols = county_forecast(spark, sf)
    return FT.weather_family(_items(spark, sf), cw, cols, "forecast")


def _integrated_sql(cte, src, col, days, out):
    sl = _sliding_sql(src, col, days, out)
    return f"""WITH {cte}, sl AS ({sl})
SELECT {_ITEM}, a.{out} AS {out}, b.{out} AS {out}_h48 FROM panel p
LEFT JOIN sl a ON a.county = p.county AND CAST(a.datetime + INTERVAL 24 HOUR AS DATE) = CAST(p.datetime AS DATE)
LEFT JOIN sl b ON b.county = p.county AND CAST(b.datetime + INTERVAL 48 HOUR AS DATE) = CAST(p.datetime AS DATE)"""


@query("lag_integrated_rain", _integrated_sql(HCW_CTE, "hcw", "rain", 7, "rain_integrated_168h_historical"),
       ("panel",) + WX_FIX)
def lag_integrated_rain(spark, sf):
    cw, _ = county_hist(spark, sf)
    out = FT.integrated_family(FT.with_date(_items(spark, sf)), cw, "rain", 7, "rain_integrated_168h_historical")
    return out.drop("date")


@query("lag_integrated_snow", _integrated_sql(FCW_CTE, "fcw", "snowfall", 2, "snowfall_integrated_48h_forecast"),
       ("panel",) + WX_FIX)
def lag_integrated_snow(spark, sf):
    cw, _ = county_forecast(spark, sf)
    out = FT.integrated_family(FT.with_date(_items(spark, sf)), cw, "snowfall", 2, "snowfall_integrated_48h_forecast")
    return out.drop("date")


DIFF_FEATURES = ["temperature", "dewpoint", "rain", "snowfall", "windspeed_10m", U, V, "humidity", "fog"]
DIFF_HLAGS = [0, 48, 168]


def _weather_diff_sql():
    joins = [G.lag_join("p", "hcw", f"h{h}", ["county"], h) for h in DIFF_HLAGS]
    joins += [G.lag_join("p", "fcw", f"f{h}", ["county"], h) for h in DIFF_HLAGS]
    sel = []
    for d in FT.DIFFS:
        for f in DIFF_FEATURES:
            for s, a in (("historical", "h0"), ("forecast", "f0")):
                sel.append(f"{a}.{G.q(f)} - h{d}.{G.q(f)} AS {G.q(f'diff_{d}h_{f}_{s}')}")
        sel.append(f"f0.surface_solar_radiation_downwards - f{d}.surface_solar_radiation_downwards "
                   f"AS diff_{d}h_surface_solar_radiation_downwards_forecast")
    return f"WITH {HCW_CTE}, {FCW_CTE} SELECT {_ITEM}, {', '.join(sel)} FROM panel p {' '.join(joins)}"


@query("weather_diffs", _weather_diff_sql(), ("panel",) + WX_FIX)
def weather_diffs(spark, sf):
    items = _items(spark, sf)
    sw = fx.station_weights(spark, sf)
    hcw, hcols = county_hist(spark, sf, sw)
    fcw, fcols = county_forecast(spark, sf, sw)
    sources = [FT.weather_source(hcw, hcols, "historical", DIFF_HLAGS), FT.weather_source(fcw, fcols, "forecast", DIFF_HLAGS)]
    df = L.lag_joins(items, sources, "datetime")
    diffs = S.weather_diff_columns(DIFF_FEATURES, FT.DIFFS)
    return df.select(*FT.ITEM_KEYS, *[v.alias(k) for k, v in diffs.items()])


@query("rolling_sum_time", f"""WITH {HCW_CTE},
r AS (SELECT county, datetime,
  sum(rain) OVER (PARTITION BY county ORDER BY datetime RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS r1,
  sum(snowfall) OVER (PARTITION BY county ORDER BY datetime RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW) AS s1,
  sum(snowfall) OVER (PARTITION BY county ORDER BY datetime RANGE BETWEEN INTERVAL 259199 SECOND PRECEDING AND CURRENT ROW) AS s3
  FROM hcw)
SELECT r.county, r.datetime, coalesce(p.r1, 0.0) AS rain_1d, coalesce(r.s1, 0.0) AS snowfall_1d,
  coalesce(r.s3, 0.0) AS snowfall_3d
FROM r LEFT JOIN r p ON p.county = r.county AND p.datetime + INTERVAL 1 HOUR = r.datetime""", WX_FIX)
def rolling_sum_time_q(spark, sf):
    cw, _ = county_hist(spark, sf)
    # rain_1d is read one hour later (the reference moves the timestamps by +1 h first).
    sums = [Rolling("rain", 86400, "rain_1d", shift=3600), Rolling("snowfall", 86400, "snowfall_1d"), Rolling("snowfall", 3 * 86400, "snowfall_3d")]
    return rolling_sums_time(cw.select("county", "datetime", "rain", "snowfall"), ["county"], "datetime", sums).drop("rain", "snowfall")


@query("gap_shift_fill", """
SELECT * FROM hist_weather WHERE datetime < TIMESTAMP '2024-01-20 11:00:00'
UNION ALL
SELECT * REPLACE (datetime + INTERVAL 48 HOUR AS datetime) FROM hist_weather
WHERE datetime BETWEEN TIMESTAMP '2024-01-18 11:00:00' AND TIMESTAMP '2024-01-19 23:00:00'""", ("hist_weather",))
def gap_shift_fill(spark, sf):
    return C.gap_shift_fill(fx.hist_weather(spark, sf), "datetime", "2024-01-18 11:00:00", "2024-01-19 23:00:00",
                            "2024-01-20 11:00:00", 48)
