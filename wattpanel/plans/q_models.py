"""Modelling queries: solar formula and fit, tree ensembles, second order, routing, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as K
from ..operators.lags import lag_fallback
from ..session import cut_lineage
from ..sources import fixtures as fx
from ..sources.io import read_table
from . import features as FT
from . import models as MD
from . import solar as SO
from .q_metrics import EV, eval_frame
from .q_weather import FCW_CTE, HCW_CTE, WX_FIX, county_forecast, county_hist
from .registry import query

SEG = FT.SEGMENT
_WX = ["temperature", "dewpoint", "snowfall", "rain", "windspeed_10m"]

# --- The production frame: delayed client, county weather at lag 0, hour -------------------------
SX_CTE = f"""{HCW_CTE}, {FCW_CTE},
sx AS (SELECT p.row_id, p.county, p.is_business, p.product_type, p.is_consumption, p.datetime, p.target,
  coalesce(c.installed_capacity, 0.0) AS installed_capacity, coalesce(c.eic_count, 0.0) AS eic_count,
  CAST(hour(p.datetime) AS INTEGER) AS hour,
  {', '.join(f'h.{c} AS {c}_historical' for c in _WX)},
  {', '.join(f'f.{c} AS {c}_forecast' for c in _WX)},
  f.surface_solar_radiation_downwards AS surface_solar_radiation_downwards_forecast
FROM panel p
LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business AND c.product_type = p.product_type
  AND c.date + INTERVAL 2 DAY = CAST(p.datetime AS DATE)
LEFT JOIN hcw h ON h.county = p.county AND h.datetime = p.datetime
LEFT JOIN fcw f ON f.county = p.county AND f.datetime = p.datetime)"""
SX_FIX = ("panel", "client") + WX_FIX


def solar_frame(spark, sf, production_only: bool = True, panel=None):
    p = fx.panel(spark, sf) if panel is None else panel
    if production_only:
        p = p.filter(F.col("is_consumption") == 0)
    items = FT.client_features(FT.with_date(p), fx.client(spark, sf)).drop("date")
    sw = fx.station_weights(spark, sf)
    hcw, _ = county_hist(spark, sf, sw)
    fcw, _ = county_forecast(spark, sf, sw)
    h = hcw.select("county", "datetime", *[F.col(c).alias(f"{c}_historical") for c in _WX])
    f = fcw.select("county", "datetime", *[F.col(c).alias(f"{c}_forecast") for c in _WX],
                   F.col("surface_solar_radiation_downwards").alias("surface_solar_radiation_downwards_forecast"))
    out = items.join(h, ["county", "datetime"], "left").join(f, ["county", "datetime"], "left")
    return out.withColumn("hour", F.hour("datetime"))


# --- SQL form of the solar formula (written independently of the column builder) -------------------
def _d(v):
    return f"CAST({float(v)!r} AS DOUBLE)"


def solar_sql(params: dict, reg: dict) -> str:
    r = reg
    p = {k: _d(v) for k, v in params.items()}
    rain = f"(CASE WHEN 1.0 - {p['C_rain']} * {r['rain']} < 0 THEN 0.0 ELSE 1.0 - {p['C_rain']} * {r['rain']} END)" \
        if "C_rain" in p else "1.0"
    s = r["snowfall"]
    if "C_snow_thr" in p and "C_snow_const" in p:
        snow = f"(CASE WHEN {s} > {p['C_snow_thr']} THEN {p['C_snow_const']} ELSE 1.0 END)"
    elif "C_snow_magnitude" in p and "C_snow_eps" in p:
        m, e = p["C_snow_magnitude"], p["C_snow_eps"]
        snow = (f"(CASE WHEN {s} < {m} - {e} THEN 1.0 WHEN {s} < 0.5 THEN {m} / ({s} + {e}) "
                f"ELSE {m} / (0.5 + {e}) END)")
    else:
        snow = "1.0"
    wind = f"(1.0 + {p['C_wind']} * {r['windspeed_10m']})" if "C_wind" in p else "1.0"
    t, d, ws = r["temperature"], r["dewpoint"], r["windspeed_10m"]
    hum = f"(100 * (exp(17.625 * {d} / (243.04 + {d})) / exp(17.625 * {t} / (243.04 + {t}))))"
    fogi = f"({hum} * (CASE WHEN {ws} < 2.0 THEN 1.0 ELSE 1.0 / {ws} END) / 100)"
    fog = f"(CASE WHEN 1.0 - {p['C_fog']} * {fogi} < 0 THEN 0.0 ELSE 1.0 - {p['C_fog']} * {fogi} END)" \
        if "C_fog" in p else "1.0"
    dew = f"(CASE WHEN {r['hour']} > 6 AND {r['hour']} < 9 THEN {p['C_dew']} ELSE 1.0 END)" \
        if "C_dew" in p and "hour" in r else "1.0"
    i = f"({r['shortwave_radiation']} / 1000)"
    if all(k in p for k in ("C_rad_tot_k1", "C_rad_tot_k2", "C_rad_tot_k3")):
        b1, b2, k1, k2, k3 = (p[k] for k in ("C_rad_tot_b1", "C_rad_tot_b2", "C_rad_tot_k1", "C_rad_tot_k2",
                                             "C_rad_tot_k3"))
        sw = (f"(CASE WHEN {i} <= {b1} THEN {i} * {k1} WHEN {i} >= {b2} THEN ({i} - {b2}) * {k3} + {b2} * {k2} + "
              f"{b1} * {k1} ELSE ({i} - {b1}) * {k2} + {b1} * {k1} END)")
    elif "C_rad_tot_scale" in p:
        sw = f"({i} * {p['C_rad_tot_scale']})"
    else:
        sw = i
    temp = f"(CASE WHEN {t} > 25.0 THEN 1.0 + {p['C_temperature']} * ({t} - 25.0) ELSE 1.0 END)" \
        if "C_temperature" in p else "1.0"
    eta = f"({_d(0.17)} * {rain} * {snow} * {wind} * {temp} * {fog} * {dew})"
    area = p.get("C_area", _d(4.0))
    return f"({area} * {r['installed_capacity']} * {sw} * {eta})"


REG_SQL = {k: v for k, v in SO.REGRESSORS.items()}
REG_HOUR = {**SO.REGRESSORS, "hour": "hour"}


@query("solar_formula", f"""WITH {SX_CTE}
SELECT row_id, {solar_sql(SO.DEFAULT_WEIGHTS, REG_SQL)} AS prediction,
  {solar_sql(SO.DEFAULT_WEIGHTS, REG_HOUR)} AS prediction_dew
FROM sx WHERE is_consumption = 0""", SX_FIX)
def solar_formula(spark, sf):
    df = solar_frame(spark, sf)
    return df.select("row_id", SO.solar_output(SO.DEFAULT_WEIGHTS).alias("prediction"),
                     SO.solar_output(SO.DEFAULT_WEIGHTS, REG_HOUR).alias("prediction_dew"))


VARIANTS = {
    "prediction_v1": {"C_area": 3.0, "C_rain": 0.2, "C_snow_magnitude": 0.8, "C_snow_eps": 0.1, "C_wind": 0.05,
                      "C_temperature": -0.004, "C_rad_tot_scale": 0.9},
    "prediction_v2": {},
    "prediction_v3": {"C_fog": 0.5, "C_dew": 0.7, "C_temperature_low": 0.1},
}


@query("solar_formula_variants", f"""WITH {SX_CTE}
SELECT row_id, {', '.join(f'{solar_sql(v, REG_HOUR)} AS {k}' for k, v in VARIANTS.items())}
FROM sx WHERE is_consumption = 0""", SX_FIX)
def solar_formula_variants(spark, sf):
    df = solar_frame(spark, sf)
    return df.select("row_id", *[SO.solar_output(v, REG_HOUR).alias(k) for k, v in VARIANTS.items()])


def group_params():
    out = {}
    for g in (0, 1, 2):
        theta = dict(SO.DEFAULT_WEIGHTS)
        theta["C_area"] = theta["C_area"] * (1 + 0.1 * g)
        theta["C_rain"] = 0.1 + 0.1 * g
        out[g] = theta
    return out


def _group_sql():
    gp = group_params()
    seen = ", ".join(str(g) for g in gp)
    cases = " ".join(f"WHEN product_type = {g} THEN {solar_sql(th, REG_SQL)}" for g, th in gp.items())
    avg = " + ".join(solar_sql(th, REG_SQL) for th in gp.values())
    return f"""WITH {SX_CTE}
SELECT row_id, product_type, CASE {cases} ELSE ({avg}) / {len(gp)} END AS prediction
FROM sx WHERE is_consumption = 0"""


@query("solar_group_predict", _group_sql(), SX_FIX)
def solar_group_predict(spark, sf):
    """Product types 0-2 have fitted parameters; type 3 is unseen and gets the average of all groups."""
    df = solar_frame(spark, sf)
    params = SO.params_frame(spark, "product_type", group_params())
    return SO.group_predict(df, params, "product_type").select("row_id", "product_type", "prediction")


@query("solar_fit")
def solar_fit(spark, sf):
    """Pattern-search fit per product type; one row per (group, parameter) with the final MAE, rounds used and converged."""
    df = solar_frame(spark, sf)
    state, _ = SO.fit_pattern_search(df, "product_type", "target")
    rows = [(int(g), n, float(v), float(s["mae"]), int(s["n"]), s["rounds"], s["converged"]) for g, s in state.items()
            for n, v in sorted(s["theta"].items())]
    return spark.createDataFrame(rows, "product_type long, param string, value double, mae double, n long, "
                                       "rounds long, converged boolean")


RESTARTS = 24


@query("param_stability")
def param_stability(spark, sf):
    """Random restarts and the drop-one study (J15): ``RESTARTS`` start points per product type (run_group ``run_type``), and one fit
    without each parameter (``without parameter_type``), each kind searched in the same jobs over the same rows."""
    frame = cut_lineage(solar_frame(spark, sf))
    state, _ = SO.fit_pattern_search(frame, "product_type", "target", restarts=RESTARTS, seed=7)
    dropped, _ = SO.fit_pattern_search(frame, "product_type", "target", drop_one=True)
    state = {**state, **{f"without {k}": s for k, s in dropped.items()}}
    rows = [(str(k), float(s["mae"]), int(s["n"]), s["rounds"], s["converged"], *[float(s["theta"][n]) for n in sorted(SO.DEFAULT_WEIGHTS)])
            for k, s in state.items()]
    cols = "run_group string, mae double, n long, rounds long, converged boolean, " + ", ".join(f"{n} double" for n in sorted(SO.DEFAULT_WEIGHTS))
    return spark.createDataFrame(rows, cols)


# --- Trees ------------------------------------------------------------------------------------------
GBT_FEATURES = ["county", "is_business", "product_type", "is_consumption", "hour", "dayofyear", "weekday", "p48", "p168"]

GBT_SEEDS = (0, 1)
GBT_PARAMS = {"maxIter": 20, "maxDepth": 6, "minInstancesPerNode": 20}


@query("gbt_ensemble")
def gbt_ensemble(spark, sf):
    """Two-seed L1 GBT ensemble trained on the first two thirds of the data's span and scored after it."""
    e = cut_lineage(eval_frame(spark, sf).withColumns(FT.S.calendar_columns()))  # read by the cut, every fit and the scores
    cut = F.lit(K.fraction_cuts(e, [2 / 3])[0]).cast("timestamp")
    models = MD.fit_gbt_ensemble(e.filter(F.col("datetime") <= cut), GBT_FEATURES, "target", seeds=GBT_SEEDS, params=GBT_PARAMS)
    return MD.predict_ensemble(models, e.filter(F.col("datetime") > cut), GBT_FEATURES).select("row_id", "prediction")


# --- Column algebra around the models --------------------------------------------------------------
_CAP = "installed_capacity"


@query("second_order_prep", f"""WITH {SX_CTE},
s AS (SELECT row_id, target, {_CAP}, {solar_sql(SO.DEFAULT_WEIGHTS, REG_SQL)} AS pfo FROM sx WHERE is_consumption = 0),
t AS (SELECT row_id, target, {_CAP}, CASE WHEN {_CAP} > 0 THEN pfo / {_CAP} ELSE 0.0 END AS share FROM s)
SELECT row_id, share AS predictions_first_order_share,
  CASE WHEN {_CAP} > 0 THEN target / {_CAP} ELSE target END AS target_per_capacity,
  CASE WHEN share * 0.9 - 0.01 < 0 THEN 0.0 ELSE share * 0.9 - 0.01 END * {_CAP} AS prediction_second_order
FROM t""", SX_FIX)
def second_order_prep(spark, sf):
    df = solar_frame(spark, sf).withColumn("predictions_first_order", SO.solar_output(SO.DEFAULT_WEIGHTS))
    df = df.withColumn("predictions_first_order_share", MD.first_order_share())
    raw = F.col("predictions_first_order_share") * 0.9 - 0.01
    return df.select("row_id", "predictions_first_order_share", MD.capacity_target().alias("target_per_capacity"),
                     MD.capacity_restore(raw).alias("prediction_second_order"))


@query("two_order_combine", f"""WITH {SX_CTE},
s AS (SELECT row_id, target, {_CAP}, {solar_sql(SO.DEFAULT_WEIGHTS, REG_SQL)} AS first FROM sx WHERE is_consumption = 0),
t AS (SELECT *, CASE WHEN (target - first) / nullif({_CAP}, 0) * 0.5 < 0 THEN 0.0
  ELSE (target - first) / nullif({_CAP}, 0) * 0.5 END * {_CAP} AS second FROM s)
SELECT row_id, target - first AS residual_target, second, first + second AS prediction FROM t""", SX_FIX)
def two_order_combine(spark, sf):
    """Residual second order with a given raw prediction (half the capacity-normalised residual)."""
    df = solar_frame(spark, sf).withColumn("first", SO.solar_output(SO.DEFAULT_WEIGHTS))
    raw = F.try_divide(F.col("target") - F.col("first"), F.when(F.col(_CAP) != 0, F.col(_CAP))) * 0.5
    df = df.withColumns({"residual_target": MD.residual_target("target", "first"),
                         "second": MD.capacity_restore(raw)})
    return df.select("row_id", "residual_target", "second", MD.two_order_combine("first", "second").alias("prediction"))


@query("month_switch", """
SELECT l_orderkey, l_linenumber, CASE WHEN x < 0 THEN 0.0 ELSE x END AS prediction FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN month(l_shipdate) IN (11, 12, 1, 2, 3)
    THEN l_extendedprice * (1 - l_discount) - 30000 ELSE l_extendedprice * l_tax - 1000 END AS x FROM lineitem)""")
def month_switch(spark, sf):
    li = read_table(spark, sf, "lineitem").withColumns({
        "first": F.col("l_extendedprice") * (1 - F.col("l_discount")) - 30000,
        "second": F.col("l_extendedprice") * F.col("l_tax") - 1000})
    return li.select("l_orderkey", "l_linenumber", MD.month_switch("first", "second", "l_shipdate").alias("prediction"))


@query("consumption_prep", f"""WITH {SX_CTE},
pr AS (SELECT county, is_business, product_type, datetime, {solar_sql(SO.DEFAULT_WEIGHTS, REG_SQL)} AS pp
  FROM sx WHERE is_consumption = 0)
SELECT c.row_id, CASE WHEN c.eic_count > 0 THEN c.target / c.eic_count ELSE c.target END AS target_per_eic,
  CASE WHEN c.{_CAP} > 0 THEN pr.pp / c.{_CAP} ELSE pr.pp END AS production_share,
  (CASE WHEN c.{_CAP} > 0 THEN pr.pp / c.{_CAP} ELSE pr.pp END) * 0.5 * c.eic_count AS prediction
FROM sx c LEFT JOIN pr USING (county, is_business, product_type, datetime) WHERE c.is_consumption = 1""", SX_FIX)
def consumption_prep(spark, sf):
    """Consumption rows with their production twin's prediction joined on segment and time (Q13 fixed)."""
    allrows = solar_frame(spark, sf, production_only=False)
    prod = allrows.filter(F.col("is_consumption") == 0).select(
        "county", "is_business", "product_type", "datetime",
        SO.solar_output(SO.DEFAULT_WEIGHTS).alias("predictions_production"))
    cons = allrows.filter(F.col("is_consumption") == 1).join(prod, ["county", "is_business", "product_type", "datetime"],
                                                             "left")
    share = MD.production_share()
    return cons.select("row_id", MD.eic_target().alias("target_per_eic"), share.alias("production_share"),
                       MD.eic_restore(share * 0.5).alias("prediction"))


def _diff_frame(spark, sf, panel=None):
    p = fx.panel(spark, sf) if panel is None else panel
    norm = FT.normalised_target(p, fx.client(spark, sf))
    items = FT.client_features(FT.with_date(p.filter(F.col("is_consumption") == 1)), fx.client(spark, sf))
    out = lag_fallback(items.drop("date"), norm, "target_per_eic", [48, 168])
    return out.select("row_id", "target", "eic_count", "target_per_eic_48h", "target_per_eic_168h")


def _norm_sql():
    from .q_panel import _NORM_SQL
    from .sqlgen import fallback_family_sql
    ctes, joins, raw, final = fallback_family_sql("norm", "target_per_eic", "target_per_eic", [48, 168], ())
    return f"""norm AS ({_NORM_SQL}), {', '.join(ctes)},
j AS (SELECT p.row_id, p.target, coalesce(c.eic_count, 0.0) AS eic_count, {', '.join(raw)} FROM panel p
  LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business AND c.product_type = p.product_type
    AND c.date + INTERVAL 2 DAY = CAST(p.datetime AS DATE)
  {' '.join(joins)} WHERE p.is_consumption = 1),
df AS (SELECT row_id, target, eic_count, {', '.join(final)} FROM j)"""


_YE = "CASE WHEN eic_count > 0 THEN target / eic_count ELSE target END"


@query("diff_target", f"""WITH {_norm_sql()}
SELECT row_id, {_YE} - target_per_eic_48h AS diff_target FROM df""", ("panel", "client"))
def diff_target(spark, sf):
    return _diff_frame(spark, sf).select("row_id", MD.diff_target("target", "target_per_eic_48h").alias("diff_target"))


@query("diff_restore", f"""WITH {_norm_sql()}
SELECT row_id, (({_YE} - target_per_eic_48h) * 0.5 + target_per_eic_48h) * eic_count AS prediction FROM df""",
       ("panel", "client"))
def diff_restore(spark, sf):
    """Restore a predicted difference (half the true one) to a consumption prediction."""
    df = _diff_frame(spark, sf)
    d = MD.diff_target("target", "target_per_eic_48h") * 0.5
    return df.select("row_id", MD.diff_restore(d, "target_per_eic_48h").alias("prediction"))


@query("multi_diff_average", f"""WITH {_norm_sql()}
SELECT row_id, target_per_eic_48h * eic_count AS p48, target_per_eic_168h * eic_count AS p168,
  (0.6 * (target_per_eic_48h * eic_count) + 0.4 * (target_per_eic_168h * eic_count)) / 1.0 AS prediction FROM df""",
       ("panel", "client"))
def multi_diff_average(spark, sf):
    """Two persistence difference models (zero predicted difference) at 48 h and 168 h, weighted 0.6/0.4."""
    df = _diff_frame(spark, sf).withColumns({
        "p48": MD.diff_restore(F.lit(0.0), "target_per_eic_48h"),
        "p168": MD.diff_restore(F.lit(0.0), "target_per_eic_168h")})
    return df.select("row_id", "p48", "p168", MD.weighted_average(["p48", "p168"], [0.6, 0.4]).alias("prediction"))


@query("route_predict", f"""WITH {EV}
SELECT row_id, CASE WHEN is_consumption = 0 THEN p168 ELSE p48 END AS prediction FROM ev""", ("panel",))
def route_predict(spark, sf):
    e = eval_frame(spark, sf)
    return e.select("row_id", MD.route("p168", "p48").alias("prediction"))


def _eval_sql():
    hist = solar_sql(SO.DEFAULT_WEIGHTS, REG_SQL)
    fc = solar_sql(SO.DEFAULT_WEIGHTS, {**REG_SQL, **{k: v.replace("_historical", "_forecast")
                                                      for k, v in REG_SQL.items()}})
    parts = []
    for d in ("2024-01-15", "2024-01-22"):
        y, m, dd = (int(x) for x in d.split("-"))
        for name, expr in (("historical", hist), ("forecast", fc)):
            parts.append(f"SELECT 'f-{y}-{m}-{dd}' AS fold, '{name}' AS weather, avg(abs({expr} - target)) AS mae "
                         f"FROM sx WHERE is_consumption = 0 AND datetime > TIMESTAMP '{d}'")
    return f"WITH {SX_CTE} {' UNION ALL '.join(parts)}"


@query("eval_hist_vs_forecast", _eval_sql(), SX_FIX)
def eval_hist_vs_forecast(spark, sf):
    """Per fold, validation MAE on historical weather and again with the forecast columns swapped in.

    Both errors are columns of one scan, and the folds bits of a mask, so rows meet neither a second time.
    """
    folds = K.date_folds(["2024-01-15", "2024-01-22"])
    swapped = {k: v.replace("_historical", "_forecast") for k, v in SO.REGRESSORS.items()}
    errors = {name: F.abs(SO.solar_output(SO.DEFAULT_WEIGHTS, reg) - F.col("target"))
              for name, reg in (("historical", SO.REGRESSORS), ("forecast", swapped))}
    df = solar_frame(spark, sf).withColumn("_folds", K.fold_mask(folds))
    return K.per_fold(df, folds, errors).select("fold", F.col("name").alias("weather"), F.col("mean").alias("mae"))
