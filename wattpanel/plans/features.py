"""Feature families (one function per family, each ``(items, tables) -> frame``).

Each family returns the item keys plus its own columns, so families can be built
narrow (inside whole-stage codegen's field limit), written or checkpointed, and
joined on ``row_id`` at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rowstats
from ..functions import scalars as S
from ..functions.holidays import add_holiday_flag
from ..operators import lags as L
from ..operators.geo import weather_to_county
from ..operators.windows import sliding_sum

SEGMENT = ["county", "is_business", "product_type", "is_consumption"]
ITEM_KEYS = ["row_id", *SEGMENT, "datetime"]

# Lags (hours) of each family.
WEATHER_LAGS = [24 * d for d in range(16)]  # 0 .. 360
TARGET_LAGS = [24 * d for d in range(2, 15)]  # 48 .. 336
NORM_LAGS = [24 * d for d in range(2, 16)]  # 48 .. 360
SUM_LAGS = [48, 72, 168, 336]
STAT_LAGS = [48, 72, 96, 120]
INTEGRATED_LAGS = [24, 48]
# Value columns of the target families with their lags and the lags of their group sums.
ALL_TARGETS = {"target": (TARGET_LAGS, SUM_LAGS), "target_per_eic": (NORM_LAGS, SUM_LAGS), "target_per_capacity": (NORM_LAGS, SUM_LAGS)}
# (prefix suffix, numerator lag, denominator lag) of the ratio features.
RATIOS = [("", 168, 336), ("", 48, 216), ("", 72, 240), ("", 48, 72),
          ("_all_type_sum", 48, 72), ("_all_type_sum", 168, 336),
          ("_all_county_type_sum", 48, 72), ("_all_county_type_sum", 168, 336)]
DIFFS = [48, 168]
DIFF_LAGS = [24 * d for d in (2, 3, 4, 5, 6, 7)]


def with_date(items: DataFrame) -> DataFrame:
    return items.withColumn("date", F.to_date("datetime"))


def general_features(items: DataFrame) -> DataFrame:
    """Calendar parts, segment key and cyclic encodings (H1-H3)."""
    out = items.withColumns(S.calendar_columns("datetime"))
    out = out.withColumn("segment", S.segment_key(SEGMENT))
    return out.withColumns(S.cyclic_columns())


def client_features(items: DataFrame, client: DataFrame, delay_days: int = 2) -> DataFrame:
    """Client of day D attached to rows of D + delay, nulls to 0."""
    c = client.select("county", "is_business", "product_type", F.date_add("date", delay_days).alias("date"),
                      "installed_capacity", "eic_count")
    out = items.join(c, on=["county", "is_business", "product_type", "date"], how="left")
    return out.withColumns({
        "installed_capacity": F.coalesce("installed_capacity", F.lit(0.0)),
        "eic_count": F.coalesce("eic_count", F.lit(0.0)),
    })


def _target_stats_and_ratios(df: DataFrame, p: str) -> DataFrame:
    cols = [f"{p}_{h}h" for h in STAT_LAGS]
    df = df.withColumns({f"{p}_mean": rowstats.row_mean(cols), f"{p}_std": rowstats.row_std(cols)})
    return df.withColumns({
        f"{p}{sfx}_ratio_{n}_{d}": S.ratio(f"{p}{sfx}_{n}h", f"{p}{sfx}_{d}h") for sfx, n, d in RATIOS
    })


def target_features(items: DataFrame, target: DataFrame) -> DataFrame:
    """Target lags with fallback, group sums, row stats and ratios."""
    out = L.lag_fallback(items, target, "target", TARGET_LAGS, SUM_LAGS)
    out = out.withColumns({
        "target_mean": rowstats.row_mean([f"target_{h}h" for h in STAT_LAGS]),
        "target_std": rowstats.row_std([f"target_{h}h" for h in STAT_LAGS]),
    })
    return out.withColumns({
        f"target{sfx}_ratio_{n}_{d}": S.ratio(f"target{sfx}_{n}h", f"target{sfx}_{d}h") for sfx, n, d in RATIOS
    })


def normalised_target(target: DataFrame, client: DataFrame, keep_target: bool = False) -> DataFrame:
    """Target per eic and per capacity with the same-day client."""
    t = target.withColumn("date", F.to_date("datetime"))
    c = client.select("county", "is_business", "product_type", "date", "eic_count", "installed_capacity")
    j = t.join(c, on=["county", "is_business", "product_type", "date"], how="left").withColumns({
        "installed_capacity": F.coalesce("installed_capacity", F.lit(0.0)),
        "eic_count": F.coalesce("eic_count", F.lit(0.0)),
    })
    return j.select(
        "datetime", *SEGMENT, *(["target"] if keep_target else []),
        S.per_unit("target", "eic_count").alias("target_per_eic"),
        S.per_unit("target", "installed_capacity").alias("target_per_capacity"),
    )


def target_norm_features(items: DataFrame, target: DataFrame, client: DataFrame) -> DataFrame:
    """Normalised target lags with fallback, sums, stats and ratios."""
    norm = normalised_target(target, client)
    specs = {f"target_per_{n}": (NORM_LAGS, SUM_LAGS) for n in ("eic", "capacity")}
    out = L.lag_fallback_multi(items, norm, specs)
    for name in ("eic", "capacity"):
        out = _target_stats_and_ratios(out, f"target_per_{name}")
    return out


def all_target_features(items: DataFrame, target: DataFrame, client: DataFrame) -> DataFrame:
    """Target and normalised-target families in one pass: five joins for all three columns."""
    norm = normalised_target(target, client, keep_target=True)
    return all_target_columns(L.lag_joins(items, L.fallback_sources(norm, ALL_TARGETS), "datetime"))


def all_target_columns(lagged: DataFrame) -> DataFrame:
    """The target families from the lags of :func:`operators.lags.fallback_sources` with ``ALL_TARGETS``."""
    out = L.fallback_columns(lagged, ALL_TARGETS)
    for p in ALL_TARGETS:
        out = _target_stats_and_ratios(out, p)
    return target_norm_diff_features(out)


def target_norm_diff_features(df: DataFrame) -> DataFrame:
    """Differences of per-eic lags and their median / q25 / q75 (H13, D8 nearest)."""
    p = "target_per_eic"
    df = df.withColumns(S.lag_diff_columns(p, DIFF_LAGS, DIFFS))
    for d in DIFFS:
        cols = [f"{p}_diff_{d}h_lag{l}h" for l in DIFF_LAGS]
        df = df.withColumns({
            f"{p}_diff_{d}h_median": rowstats.row_median(cols),
            f"{p}_diff_{d}h_q25": rowstats.row_quantile(cols, 0.25, "nearest"),
            f"{p}_diff_{d}h_q75": rowstats.row_quantile(cols, 0.75, "nearest"),
        })
    return df


def prepare_hist_weather(hw: DataFrame, angle: str = "reference", u: str = "10_metre_u_wind_component",
                         v: str = "10_metre_v_wind_component") -> tuple[DataFrame, list[str]]:
    """Wind components, fog and humidity; drop the direction (H4-H7)."""
    cols = [c for c in hw.columns if c not in ("datetime", "latitude", "longitude", "winddirection_10m")]
    uu, vv = S.wind_uv("windspeed_10m", "winddirection_10m", angle)
    out = hw.withColumns({
        u: uu, v: vv,
        "fog": S.fog_intensity("temperature", "dewpoint", "windspeed_10m"),
        "humidity": S.relative_humidity("temperature", "dewpoint"),
    }).drop("winddirection_10m")
    return out, cols + [u, v, "fog", "humidity"]


def valid_forecasts(fw: DataFrame, min_hours_ahead: int = 23, start=None, latest_issue_only: bool = False) -> DataFrame:
    """Valid time and hours-ahead filter (H10, B5, Q5); all other columns as they are."""
    f = fw.filter(F.col("hours_ahead") >= min_hours_ahead).withColumn("datetime", S.forecast_valid_time())
    if latest_issue_only:
        from pyspark.sql import Window
        w = Window.partitionBy("latitude", "longitude", "datetime").orderBy(F.col("origin_datetime").desc())
        f = f.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    drop = [c for c in ("hours_ahead", "forecast_datetime", "origin_datetime") if c in f.columns]
    f = f.drop(*drop)
    return f if start is None else f.filter(F.col("datetime") >= F.lit(start))


def forecast_units(f: DataFrame, u: str = "10_metre_u_wind_component", v: str = "10_metre_v_wind_component") -> tuple[DataFrame, list[str]]:
    """Rain/snow units, wind speed, fog, humidity (H5-H9)."""
    cols = [c for c in f.columns if c not in ("datetime", "latitude", "longitude")]
    f = f.withColumns(S.precipitation_columns()).withColumn("windspeed_10m", S.wind_speed(u, v))
    f = f.withColumns({
        "fog": S.fog_intensity("temperature", "dewpoint", "windspeed_10m"),
        "humidity": S.relative_humidity("temperature", "dewpoint"),
    })
    return f, cols + ["windspeed_10m", "rain", "fog", "humidity"]


def prepare_forecast_weather(fw: DataFrame, min_hours_ahead: int = 23, start=None, u: str = "10_metre_u_wind_component",
                             v: str = "10_metre_v_wind_component", latest_issue_only: bool = False
                             ) -> tuple[DataFrame, list[str]]:
    """Valid time, hours-ahead filter, rain/snow units, wind speed, fog, humidity."""
    return forecast_units(valid_forecasts(fw, min_hours_ahead, start, latest_issue_only), u, v)


def weather_family(items: DataFrame, county_weather: DataFrame, cols: Sequence[str], kind: str,
                   lags: Sequence[int] = WEATHER_LAGS) -> DataFrame:
    """County weather renamed ``{c}_{kind}`` and lag-joined at 0..360 h, first lag unsuffixed."""
    return L.lag_joins(items, [weather_source(county_weather, cols, kind, lags)], "datetime")


def weather_source(county_weather: DataFrame, cols: Sequence[str], kind: str, lags: Sequence[int] = WEATHER_LAGS) -> L.LagSource:
    """County weather as a source of lag joins, its columns renamed ``{c}_{kind}``."""
    renamed = county_weather.select("datetime", "county", *[F.col(f"`{c}`").alias(f"{c}_{kind}") for c in cols])
    return L.LagSource(renamed, ["county"], [f"{c}_{kind}" for c in cols], list(lags), L.suffix_after_first(list(lags)))


def station_source(weather: DataFrame, stations_w: DataFrame, prepare: Callable[[DataFrame], tuple[DataFrame, list[str]]], kind: str,
                   lags: Sequence[int] = WEATHER_LAGS) -> L.LagSource:
    """:func:`weather_source` from the stations' raw rows: these are narrow and travel, the counties' rows are made where the lags are read."""
    _, cols = prepare(weather)

    def rows(raw: DataFrame, by: Sequence[str]) -> DataFrame:
        made = weather_to_county(prepare(raw)[0], stations_w, cols, dealt=by)
        return made.select(*by, "datetime", "county", *[F.col(f"`{c}`").alias(f"{c}_{kind}") for c in cols])

    return L.LagSource(weather, ["county"], [f"{c}_{kind}" for c in cols], list(lags), L.suffix_after_first(list(lags)), rows)


def integrated_family(items: DataFrame, county_weather: DataFrame, col: str, period_days: int, out: str,
                      lags: Sequence[int] = INTEGRATED_LAGS) -> DataFrame:
    """Sliding ``period_days`` sum per county, shifted 24/48 h to a date and joined."""
    return integrated_families(items, county_weather, [(col, period_days, out)], lags)


def integrated_families(items: DataFrame, county_weather: DataFrame, specs: Sequence[tuple[str, int, str]],
                        lags: Sequence[int] = INTEGRATED_LAGS) -> DataFrame:
    """Several sliding sums (``(col, days, out)``), each computed once, lagged and joined in one pass.

    The window tables are tiny (county x day); window ends fall on midnights, so a
    shift by whole days lands on one date per county.
    """
    tables = [sliding_sum(county_weather, ["county"], "datetime", c, f"{d} days", "1 day", o) for c, d, o in specs]
    sl = tables[0]
    for t in tables[1:]:
        sl = sl.join(t, on=["county", "datetime"], how="full")
    outs = [o for _, _, o in specs]
    lt = L.lag_table(sl, ["county"], "datetime", outs, lags, L.suffix_after_first(list(lags)))
    lt = lt.withColumn("date", F.to_date("datetime")).drop("datetime")
    return items.join(lt, on=["county", "date"], how="left")


def county_hist_weather(hist_weather: DataFrame, stations_w: DataFrame, angle: str = "reference"
                        ) -> tuple[DataFrame, list[str]]:
    """Historical weather per (datetime, county), station-weighted."""
    hw, cols = prepare_hist_weather(hist_weather, angle)
    return weather_to_county(hw, stations_w, cols), cols


def county_forecast_weather(forecast_weather: DataFrame, stations_w: DataFrame, **kw) -> tuple[DataFrame, list[str]]:
    """Forecast weather per (valid datetime, county), station-weighted."""
    fw, cols = prepare_forecast_weather(forecast_weather, **kw)
    return weather_to_county(fw, stations_w, cols), cols


HIST_SUMS = [("rain", 7, "rain_integrated_168h_historical")]
FORECAST_SUMS = [("rain", 7, "rain_integrated_168h_forecast"), ("snowfall", 2, "snowfall_integrated_48h_forecast")]


def historical_family(items: DataFrame, cw: DataFrame, cols: Sequence[str]) -> DataFrame:
    return integrated_families(weather_family(items, cw, cols, "historical"), cw, HIST_SUMS)


def forecast_family(items: DataFrame, cw: DataFrame, cols: Sequence[str]) -> DataFrame:
    return integrated_families(weather_family(items, cw, cols, "forecast"), cw, FORECAST_SUMS)


def historical_weather_features(items: DataFrame, hist_weather: DataFrame, stations_w: DataFrame,
                                angle: str = "reference") -> DataFrame:
    cw, cols = county_hist_weather(hist_weather, stations_w, angle)
    return historical_family(items, cw, cols)


def forecast_weather_features(items: DataFrame, forecast_weather: DataFrame, stations_w: DataFrame,
                              **kw) -> DataFrame:
    cw, cols = county_forecast_weather(forecast_weather, stations_w, **kw)
    return forecast_family(items, cw, cols)


def holiday_features(df: DataFrame) -> DataFrame:
    return add_holiday_flag(df, "date")
