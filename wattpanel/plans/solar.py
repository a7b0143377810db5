"""Physical solar-output model as column expressions, group scoring and a distributed fit.

The fit replaces a one-node Nelder-Mead per group with a bounded pattern search: every round scores all
candidate parameter vectors of all groups in one pass over the training rows (an aggregate column each), and
the search's state is a table of one row per start and group that never leaves Spark.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import bounded_broadcast, cut_lineage

# Fixed values that must equal the reference's: default weights and bounds of the
# solar model, reference temperature (deg C) and base panel efficiency.
DEFAULT_WEIGHTS = {
    "C_area": 4.046345258643658,
    "C_fog": 0.14347390597725973,
    "C_dew": 0.653589763694636,
    "C_rain": 0.1,
    "C_rad_tot_k1": 0.3,
    "C_rad_tot_k2": 0.74,
    "C_rad_tot_k3": 0.4,
    "C_rad_tot_b1": 0.097,
    "C_rad_tot_b2": 0.6,
    "C_snow_thr": 0.3,
    "C_snow_const": 0.0014,
}
BOUNDS = {
    "C_area": (0.0, 10.0),
    "C_fog": (0.0, 1.0),
    "C_dew": (0.0, 1.0),
    "C_rain": (0.1, 1.0),
    "C_rad_tot_k1": (0.0, 1.0),
    "C_rad_tot_k2": (0.0, 1.0),
    "C_rad_tot_k3": (0.0, 1.0),
    "C_rad_tot_b1": (0.0, 0.2),
    "C_rad_tot_b2": (0.2, 0.8),
    "C_snow_thr": (0.2, 0.5),
    "C_snow_const": (0.0, 1.0),
}
BASELINE_TEMPERATURE = 25.0
BASELINE_EFFICIENCY = 0.17
DEFAULT_AREA = 4.0

# Regressor name -> feature column (the production model's configuration).
REGRESSORS = {
    "temperature": "temperature_historical",
    "dewpoint": "dewpoint_historical",
    "shortwave_radiation": "surface_solar_radiation_downwards_forecast",
    "snowfall": "snowfall_historical",
    "rain": "rain_historical",
    "windspeed_10m": "windspeed_10m_historical",
    "installed_capacity": "installed_capacity",
}

# What a dropped parameter and its partners are frozen at, so that its term leaves the formula.
NEUTRAL = {
    "C_area": {"C_area": DEFAULT_AREA},
    "C_fog": {"C_fog": 0.0},
    "C_dew": {"C_dew": 1.0},
    "C_rain": {"C_rain": 0.0},
    "C_snow_thr": {"C_snow_thr": 0.0, "C_snow_const": 1.0},
    "C_snow_const": {"C_snow_thr": 0.0, "C_snow_const": 1.0},
    **{k: {"C_rad_tot_k1": 1.0, "C_rad_tot_k2": 1.0, "C_rad_tot_k3": 1.0, "C_rad_tot_b1": 0.0, "C_rad_tot_b2": 1.0}
       for k in ("C_rad_tot_k1", "C_rad_tot_k2", "C_rad_tot_k3")},
    "C_rad_tot_b1": {"C_rad_tot_b1": 0.0},
    "C_rad_tot_b2": {"C_rad_tot_b2": 1e9},
}
MAX_GROUPS = 100_000  # parameter sets broadcast at most
_STATE_PARTITIONS = 8

Param = float | Column


def _lit(v: Param) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def _nonneg(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def solar_output(params: Mapping[str, Param], regressors: Mapping[str, str] = REGRESSORS,
                 baseline_temperature: float = BASELINE_TEMPERATURE,
                 baseline_efficiency: float = BASELINE_EFFICIENCY) -> Column:
    """area * capacity * I(radiation) * eta; optional terms switched on by parameter names."""
    r = {k: F.col(f"`{v}`") for k, v in regressors.items() if v is not None}
    p = {k: _lit(v) for k, v in params.items()}
    one = F.lit(1.0)

    rain = _nonneg(one - p["C_rain"] * r["rain"]) if "C_rain" in p else one
    if "C_snow_thr" in p and "C_snow_const" in p:
        snow = F.when(r["snowfall"] > p["C_snow_thr"], p["C_snow_const"]).otherwise(one)
    elif "C_snow_magnitude" in p and "C_snow_eps" in p:
        mag, eps, s = p["C_snow_magnitude"], p["C_snow_eps"], r["snowfall"]
        base = F.when(s < 0.5, mag / (s + eps)).otherwise(mag / (F.lit(0.5) + eps))
        snow = F.when(s < mag - eps, one).otherwise(base)
    else:
        snow = one
    wind = (one + p["C_wind"] * r["windspeed_10m"]) if "C_wind" in p else one
    fog = (_nonneg(one - p["C_fog"] * (r["fog"] if "fog" in r else S.fog_intensity(r["temperature"], r["dewpoint"], r["windspeed_10m"])))
           if "C_fog" in p else one)
    dew = (F.when((r["hour"] > 6) & (r["hour"] < 9), p["C_dew"]).otherwise(one)
           if "C_dew" in p and "hour" in r else one)
    radiation = r["shortwave_radiation"] / 1000
    if all(k in p for k in ("C_rad_tot_k1", "C_rad_tot_k2", "C_rad_tot_k3")):
        b1, b2, k1, k2, k3 = p["C_rad_tot_b1"], p["C_rad_tot_b2"], p["C_rad_tot_k1"], p["C_rad_tot_k2"], p["C_rad_tot_k3"]
        shortwave = (F.when(radiation <= b1, radiation * k1)
                     .when(radiation >= b2, (radiation - b2) * k3 + b2 * k2 + b1 * k1)
                     .otherwise((radiation - b1) * k2 + b1 * k1))
    elif "C_rad_tot_scale" in p:
        shortwave = radiation * p["C_rad_tot_scale"]
    else:
        shortwave = radiation
    t = r["temperature"]
    temp = (F.when(t > baseline_temperature, one + p["C_temperature"] * (t - baseline_temperature)).otherwise(one)
            if "C_temperature" in p else one)
    eta = F.lit(baseline_efficiency) * rain * snow * wind * temp * fog * dew
    area = p.get("C_area", F.lit(DEFAULT_AREA))
    return area * r["installed_capacity"] * shortwave * eta


def params_frame(spark, group_col: str, params: Mapping[object, Mapping[str, float]]) -> DataFrame:
    """Small table: one row per group with one column per parameter."""
    names = sorted({k for v in params.values() for k in v})
    rows = [(g, *[float(v[n]) for n in names]) for g, v in params.items()]
    return spark.createDataFrame(rows, [group_col, *names])


def group_predict(df: DataFrame, params: DataFrame, group_col: str, regressors: Mapping[str, str] = REGRESSORS,
                  out: str = "prediction") -> DataFrame:
    """Score each row with its group's parameters; rows of unseen or null groups get the mean over all groups.

    Both come by joins: a row a group, and one row with all parameter sets for the rows that found none, whose
    formulas are averaged as an array.  No parameter passes the driver, and the plan does not grow with the groups.
    """
    names = [c for c in params.columns if c != group_col]
    packed = params.select(group_col, F.struct(*names).alias("_p"))
    joined = df.join(bounded_broadcast(packed, MAX_GROUPS), on=group_col, how="left")
    every = packed.agg(F.collect_list("_p").alias("_every")).withColumn("_none", F.lit(True))
    joined = joined.withColumn("_none", F.col("_p").isNull())
    joined = joined.join(bounded_broadcast(every, 1), on="_none", how="left")
    own = solar_output({n: F.col(f"_p.{n}") for n in names}, regressors)
    each = F.transform("_every", lambda p: solar_output({n: p.getField(n) for n in names}, regressors))
    mean = F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_every"), F.lit(1))
    return joined.withColumn(out, F.when(F.col("_none"), mean).otherwise(own)).select(*df.columns, out)


# --- Fit -----------------------------------------------------------------------------------------
def _theta(names: Sequence[str], values: Mapping[str, float]) -> Column:
    return F.array(*[F.lit(float(values[n])) for n in names])


def _moved(i: int, sign: int, lo: float, hi: float) -> Column:
    """Parameter ``i`` one step up or down, inside its bounds; a frozen one (step 0) stays where it is."""
    at, step = F.col("_theta")[i], F.col("_steps")[i]
    return F.when(step == 0, at).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), at + sign * step)))


def uniform_start(names: Sequence[str], bounds: Mapping[str, tuple[float, float]], seed: int, *keys: str) -> Column:
    """A start point inside the bounds, from a hash of the seed and the key columns."""
    def u(n: str) -> Column:
        h = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}:{n}"), *keys), 11).cast("double") * F.lit(2.0 ** -53)
        lo, hi = bounds[n]
        return F.lit(lo) + h * F.lit(hi - lo)

    return F.array(*[u(n) for n in names])


def search(rows: DataFrame, group_col: str, target: str, starts: DataFrame, names: Sequence[str],
           bounds: Mapping[str, tuple[float, float]] = BOUNDS, regressors: Mapping[str, str] = REGRESSORS,
           rounds: int = 1000, step_fraction: float = 0.25, min_step_fraction: float = 1e-3,
           min_gain: float = 1e-9) -> DataFrame:
    """Bounded pattern search of many starts at once.

    ``starts``: study, ``group_col``, _theta (in the order of ``names``) and _frozen (the names that stay as they are).  Every
    round each open (study, group) has itself and two moves for each parameter as candidates; their errors are
    aggregate columns of one pass over ``rows``, so no row is multiplied by its candidates, and the next state is made from
    them in Spark and cut by a checkpoint.  A candidate is taken if it is better by ``min_gain`` of the error
    (so the order of a sum decides nothing), else the steps are halved.  Returns study, group, _theta, _steps, mae, n,
    rounds, converged and trace (the error of each round).
    """
    names = list(names)
    if "C_fog" in names and "fog" not in regressors:  # no parameter in it: made once, not for each candidate of each round
        r = {k: F.col(f"`{v}`") for k, v in regressors.items() if v is not None}
        rows = cut_lineage(rows.withColumn("_fog", S.fog_intensity(r["temperature"], r["dewpoint"], r["windspeed_10m"])))
        regressors = {**regressors, "fog": "_fog"}
    spans = [bounds[n][1] - bounds[n][0] for n in names]
    moves = [(i, sign) for i in range(len(names)) for sign in (1, -1)]
    theta = {n: F.col("_theta")[i] for i, n in enumerate(names)}
    candidates = [theta] + [{**theta, names[i]: _moved(i, sign, *bounds[names[i]])} for i, sign in moves]
    errors = [F.avg(F.abs(solar_output(c, regressors) - F.col(target))).alias(f"_e{k}") for k, c in enumerate(candidates)]
    every = F.array(*[F.col(f"_e{k}") for k in range(len(candidates))])

    state = starts.select(
        "study", group_col, "_theta",
        F.array(*[F.when(F.array_contains("_frozen", n), F.lit(0.0)).otherwise(F.lit(step_fraction * w))
                  for n, w in zip(names, spans)]).alias("_steps"),
        F.lit(None).cast("double").alias("mae"), F.lit(None).cast("long").alias("n"), F.lit(0).cast("long").alias("rounds"),
        F.lit(False).alias("converged"), F.array().cast("array<double>").alias("trace"))
    state = cut_lineage(state)
    best = F.array_min(every)
    taken = best < F.col("_e0") - min_gain * F.abs("_e0")
    which = F.array_position(every, best)  # 1: itself, then the moves
    moved = F.array(*[
        F.when(taken & (which == 2 * i + 2), _moved(i, 1, *bounds[n])).when(taken & (which == 2 * i + 3), _moved(i, -1, *bounds[n]))
        .otherwise(F.col("_theta")[i]) for i, n in enumerate(names)])
    steps = F.when(taken, F.col("_steps")).otherwise(F.transform("_steps", lambda x: x / 2))
    small = F.forall(F.arrays_zip("_next", F.array(*[F.lit(w) for w in spans]).alias("_span")),
                     lambda x: x.getField("_next") <= min_step_fraction * x.getField("_span"))
    for _ in range(rounds):
        open_ = state.filter(~F.col("converged"))
        scored = rows.join(bounded_broadcast(open_.select("study", group_col, "_theta", "_steps"), MAX_GROUPS), on=group_col)
        scored = scored.groupBy("study", group_col).agg(*errors, F.count("*").alias("_n"))
        after = open_.join(scored, ["study", group_col]).select(
            "study", group_col, moved.alias("_theta"), steps.alias("_next"), F.when(taken, best).otherwise(F.col("_e0")).alias("mae"),
            F.col("_n").alias("n"), (F.col("rounds") + 1).alias("rounds"), "trace")
        after = after.select("study", group_col, "_theta", F.col("_next").alias("_steps"), "mae", "n", "rounds",
                             small.alias("converged"), F.concat("trace", F.array("mae")).alias("trace"))
        state = cut_lineage(state.filter("converged").unionByName(after).coalesce(_STATE_PARTITIONS))
        if state.filter(~F.col("converged")).isEmpty():
            break
    return state


def fit_pattern_search(df: DataFrame, group_col: str, target: str, init: Mapping[str, float] = DEFAULT_WEIGHTS,
                       bounds: Mapping[str, tuple[float, float]] = BOUNDS, regressors: Mapping[str, str] = REGRESSORS,
                       rounds: int = 1000, step_fraction: float = 0.25, min_step_fraction: float = 1e-3,
                       starts: Mapping[object, Mapping[str, float]] | None = None, restarts: int = 0, seed: int = 0,
                       drop_one: bool = False) -> tuple[dict, list[dict]]:
    """Fit the solar parameters per group by minimising MAE within bounds.

    Returns ``(state, history)``: per group the parameters, MAE, rows, rounds used and whether it
    converged (every step at most ``min_step_fraction`` of its range), and per
    round the best MAE of every group (non-increasing by construction).
    The search ends when all groups have converged; ``rounds`` is only a safety limit.
    ``starts`` overrides the start point per group; ``restarts`` adds as many random starts a group (state keys
    ``{run}_{group}``) and ``drop_one`` one fit without each parameter (keys ``{parameter}_{group}``), all in the same jobs.
    """
    names = sorted(init)
    need = sorted({v for v in regressors.values() if v} | {group_col, target})
    rows = cut_lineage(df.select(*[F.col(f"`{c}`") for c in need]).na.drop())
    groups = rows.select(group_col).distinct()
    found = search(rows, group_col, target, _starts(groups, group_col, names, init, bounds, starts, restarts, seed, drop_one),
                   names, bounds, regressors, rounds, step_fraction, min_step_fraction).collect()
    state = {}
    for r in sorted(found, key=lambda r: (str(r["study"]), str(r[group_col]))):
        key = r[group_col] if r["study"] == "" else f"{r['study']}_{r[group_col]}"
        state[key] = {"theta": dict(zip(names, r["_theta"])), "steps": dict(zip(names, r["_steps"])), "mae": r["mae"], "n": r["n"],
                      "rounds": r["rounds"], "converged": r["converged"], "trace": r["trace"]}
    most = max((s["rounds"] for s in state.values()), default=0)
    history = [{"round": k, **{str(g): s["trace"][min(k, len(s["trace"]) - 1)] for g, s in state.items()}} for k in range(most)]
    return state, history


def _starts(groups: DataFrame, group_col: str, names: Sequence[str], init: Mapping[str, float], bounds: Mapping[str, tuple[float, float]],
            starts: Mapping[object, Mapping[str, float]] | None, restarts: int, seed: int, drop_one: bool) -> DataFrame:
    none = F.array().cast("array<string>")
    if restarts:
        runs = groups.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(restarts - 1)))).select(group_col, F.col("_run").cast("string").alias("study"))
        return runs.withColumn("_theta", uniform_start(names, bounds, seed, "study", group_col)).withColumn("_frozen", none)
    if drop_one:
        without = [F.struct(F.lit(n).alias("study"), _theta(names, {**init, **NEUTRAL[n]}).alias("_theta"),
                            F.array(*[F.lit(k) for k in sorted({n, *NEUTRAL[n]})]).alias("_frozen")) for n in names]
        return groups.withColumn("_s", F.explode(F.array(*without))).select(group_col, "_s.*")
    out = groups.select(group_col, F.lit("").alias("study"), _theta(names, init).alias("_theta"), none.alias("_frozen"))
    if starts:
        own = groups.sparkSession.createDataFrame([(g, [float(v[n]) for n in names]) for g, v in starts.items()], [group_col, "_own"])
        out = out.join(own, group_col, "left").withColumn("_theta", F.coalesce("_own", "_theta")).drop("_own")
    return out


def random_starts(groups: Sequence, runs: int, bounds: Mapping[str, tuple[float, float]] = BOUNDS, seed: int = 0
                  ) -> dict:
    """Random start points within bounds, one per (run, group)."""
    rng = random.Random(seed)
    return {(run, g): {n: rng.uniform(lo, hi) for n, (lo, hi) in sorted(bounds.items())}
            for run in range(runs) for g in groups}
