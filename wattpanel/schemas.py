"""Declared schemas of the energy tables (no inference on read)."""

from pyspark.sql import types as T

D, I, L, S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()
TS, DT, FL = T.TimestampType(), T.DateType(), T.FloatType()


def _s(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SEGMENT = ["county", "is_business", "product_type", "is_consumption"]

TARGET = _s(("target", D), ("county", I), ("is_business", I), ("product_type", I), ("is_consumption", I),
            ("datetime", TS), ("row_id", L))
CLIENT = _s(("product_type", I), ("county", I), ("eic_count", D), ("installed_capacity", D), ("is_business", I),
            ("date", DT))
GAS_PRICES = _s(("forecast_date", DT), ("lowest_price_per_mwh", D), ("highest_price_per_mwh", D))
ELECTRICITY_PRICES = _s(("forecast_date", TS), ("euros_per_mwh", D))
FORECAST_WEATHER = _s(
    ("latitude", D), ("longitude", D), ("origin_datetime", TS), ("hours_ahead", I), ("temperature", D),
    ("dewpoint", D), ("cloudcover_high", D), ("cloudcover_low", D), ("cloudcover_mid", D), ("cloudcover_total", D),
    ("10_metre_u_wind_component", D), ("10_metre_v_wind_component", D), ("forecast_datetime", TS),
    ("direct_solar_radiation", D), ("surface_solar_radiation_downwards", D), ("snowfall", D),
    ("total_precipitation", D),
)
HISTORICAL_WEATHER = _s(
    ("datetime", TS), ("temperature", D), ("dewpoint", D), ("rain", D), ("snowfall", D), ("surface_pressure", D),
    ("cloudcover_total", D), ("cloudcover_low", D), ("cloudcover_mid", D), ("cloudcover_high", D),
    ("windspeed_10m", D), ("winddirection_10m", D), ("shortwave_radiation", D), ("direct_solar_radiation", D),
    ("diffuse_radiation", D), ("latitude", D), ("longitude", D),
)
STATION_COUNTY = _s(("longitude", FL), ("latitude", FL), ("county", I))
CAPITALS = _s(("county_name", S), ("capital_name", S), ("latitude", D), ("longitude", D))
COUNTY_BOUNDARIES = _s(("county_name", S), ("geometry", S))
STATIONS_WITH_WEIGHTS = _s(("county", L), ("longitude", FL), ("latitude", FL), ("dist", D), ("weights", D))

# Unique keys used by the upsert (G1).
KEYS = {
    "client": ["date", "county", "is_business", "product_type"],
    "gas_prices": ["forecast_date"],
    "electricity_prices": ["forecast_date"],
    "forecast_weather": ["forecast_datetime", "latitude", "longitude", "hours_ahead"],
    "historical_weather": ["datetime", "latitude", "longitude"],
    "target": ["datetime", "county", "is_business", "product_type", "is_consumption"],
}
