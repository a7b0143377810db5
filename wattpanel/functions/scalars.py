"""Column expressions (H1-H14, B13-B15).  All are JVM-side and codegen friendly."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
# Magnus form constants for relative humidity: 17.625 and 243.04 (deg C).
MAGNUS_A = 17.625
MAGNUS_B = 243.04
# Wind below this speed (m/s) does not thin fog.
FOG_WIND_THRESHOLD = 2.0
# Snow water equivalent (m) to snow depth (cm) factor.
SNOW_MWE_TO_CM = 424.24
# Ratio denominator guard.
RATIO_EPS = 1e-3
# Product type codes to names.
PRODUCT_NAMES = {0: "Combined", 1: "Fixed", 2: "General service", 3: "Spot"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def calendar_columns(ts: str = "datetime") -> dict[str, Column]:
    """Day of year, hour, day, weekday (Monday = 1), month, year (H1)."""
    t = F.col(ts)
    return {
        "dayofyear": F.dayofyear(t),
        "hour": F.hour(t),
        "day": F.dayofmonth(t),
        "weekday": F.weekday(t) + 1,
        "month": F.month(t),
        "year": F.year(t),
    }


def cyclic_columns(doy: str = "dayofyear", hour: str = "hour") -> dict[str, Column]:
    """sin/cos of pi*doy/183 and pi*hour/12 (H2)."""
    a = F.lit(math.pi) * F.col(doy) / 183
    b = F.lit(math.pi) * F.col(hour) / 12
    return {"sin(dayofyear)": F.sin(a), "cos(dayofyear)": F.cos(a), "sin(hour)": F.sin(b), "cos(hour)": F.cos(b)}


def segment_key(cols: Sequence[str] = ("county", "is_business", "product_type", "is_consumption")) -> Column:
    """``county_business_product_consumption``; null if any part is null (H3)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("_"))
        parts.append(F.col(c).cast("string"))
    return F.concat(*parts)


def relative_humidity(t, d) -> Column:
    """100 * exp(a*D/(b+D)) / exp(a*T/(b+T)) (H4)."""
    t, d = _c(t), _c(d)
    return 100 * (F.exp(MAGNUS_A * d / (MAGNUS_B + d)) / F.exp(MAGNUS_A * t / (MAGNUS_B + t)))


def wind_factor(ws, threshold: float = FOG_WIND_THRESHOLD) -> Column:
    """1 below the threshold, else 1/ws (H5)."""
    ws = _c(ws)
    return F.when(ws < threshold, F.lit(1.0)).otherwise(F.lit(1.0) / ws)


def fog_intensity(t, d, ws) -> Column:
    """RH * wind factor / 100 (H6)."""
    return relative_humidity(t, d) * wind_factor(ws) / 100


def wind_uv(ws, direction, angle: str = "reference") -> tuple[Column, Column]:
    """Wind components from speed and direction (H7).

    ``angle="reference"`` reproduces the reference, which multiplies degrees by
    180/pi; ``"radians"`` is the usual pi/180 conversion.
    """
    ws, direction = _c(ws), _c(direction)
    factor = 180 / math.pi if angle == "reference" else math.pi / 180
    a = direction * F.lit(factor)
    return ws * F.cos(a), ws * F.sin(a)


def wind_speed(u, v) -> Column:
    """sqrt(u^2 + v^2) (H8)."""
    u, v = _c(u), _c(v)
    return F.sqrt(v * v + u * u)


def precipitation_columns(total: str = "total_precipitation", snow: str = "snowfall") -> dict[str, Column]:
    """Rain in mm = max(0, total - snow) * 1000; snowfall in cm = snow * 424.24 (H9).

    Both read the *input* snowfall column.
    """
    diff = F.col(total) - F.col(snow)
    return {"rain": clip_floor(diff) * 1000, snow: F.col(snow) * SNOW_MWE_TO_CM}


def forecast_valid_time(origin: str = "origin_datetime", hours: str = "hours_ahead") -> Column:
    """origin + hours_ahead hours."""
    return F.col(origin) + F.make_dt_interval(F.lit(0), F.col(hours))


def ratio(num, den, eps: float = RATIO_EPS) -> Column:
    """num / (den + eps); a zero denominator gives null, not an error."""
    if isinstance(num, str) and isinstance(den, str):
        return F.expr(f"try_divide(`{num}`, `{den}` + {float(eps)!r}D)")
    return F.try_divide(_c(num), _c(den) + F.lit(eps))


def per_unit(x, d) -> Column:
    """x / d when d > 0, else x."""
    x, d = _c(x), _c(d)
    return F.when(d > 0, x / d).otherwise(x)


def clip_floor(x, lower: float = 0.0) -> Column:
    """Lower clip that keeps nulls null."""
    x = _c(x)
    return F.when(x < lower, F.lit(lower)).otherwise(x)


def product_name(code) -> Column:
    """Product code to name; unknown codes give null."""
    m = F.create_map(*[v for k, name in PRODUCT_NAMES.items() for v in (F.lit(k), F.lit(name))])
    return m[_c(code).cast("int")]


def format_name(name) -> Column:
    """Per hyphen part: first letter upper, rest lower."""
    parts = F.split(_c(name), "-")
    return F.array_join(
        F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))),
        "-",
    )


def lag_diff_columns(prefix: str, lags: Sequence[int], diffs: Sequence[int]) -> dict[str, Column]:
    """``{p}_diff_{d}h_lag{l}h`` = ``{p}_{l}h - {p}_{l+d}h``."""
    return {
        f"{prefix}_diff_{d}h_lag{l}h": F.col(f"{prefix}_{l}h") - F.col(f"{prefix}_{l + d}h")
        for l in lags
        for d in diffs
    }


def weather_diff_columns(features: Sequence[str], diffs: Sequence[int] = (48, 168),
                         suffixes: Sequence[str] = ("historical", "forecast"),
                         own_lag_feature: str | None = "surface_solar_radiation_downwards_forecast"
                         ) -> dict[str, Column]:
    """``diff_{d}h_{f}_{s}`` = ``{f}_{s}`` minus the *historical* lag ``{f}_historical_h{d}``."""
    out: dict[str, Column] = {}
    for d in diffs:
        for f in features:
            for s in suffixes:
                out[f"diff_{d}h_{f}_{s}"] = F.col(f"{f}_{s}") - F.col(f"{f}_historical_h{d}")
        if own_lag_feature:
            out[f"diff_{d}h_{own_lag_feature}"] = F.col(own_lag_feature) - F.col(f"{own_lag_feature}_h{d}")
    return out


def downcast_floats(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every double column to float (B8), but those of ``keep``."""
    return df.select(*[F.col(n).cast("float").alias(n) if t == "double" and n not in keep else F.col(n) for n, t in df.dtypes])


def swap_hist_forecast(df: DataFrame) -> DataFrame:
    """Drop columns ending in ``historical``; rename each ``..._forecast`` twin to it.

    A ``historical`` column with no forecast twin disappears; names like
    ``x_historical_h48`` do not end in ``historical`` and stay.
    """
    cols = df.columns
    hist = [c for c in cols if c.endswith("historical")]
    renames = {}
    for h in hist:
        twin = h[: -len("historical")] + "forecast"
        if twin in cols:
            renames[twin] = h
    keep = [c for c in cols if c not in hist]
    return df.select(*[F.col(f"`{c}`").alias(renames.get(c, c)) for c in keep])
