"""Queries over the segment panel: lag joins, fallback, group levels, row statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rowstats
from ..operators import lags as L
from ..sources import fixtures as fx
from . import features as FT
from . import sqlgen as G
from .registry import query

ITEM = FT.ITEM_KEYS
ITEM_SQL = ", ".join(f"p.{c}" for c in G.ITEM)


def _items(spark, sf):
    return fx.panel(spark, sf).drop("target")


# --- C5: own-segment target lags -------------------------------------------------
def _lag_target_sql():
    joins = [G.lag_join("p", "panel", f"o{h}", G.SEG, h) for h in FT.TARGET_LAGS]
    cols = [f"o{h}.target AS target_{h}h" for h in FT.TARGET_LAGS]
    return f"SELECT {ITEM_SQL}, {', '.join(cols)} FROM panel p {' '.join(joins)}"


@query("lag_target", _lag_target_sql(), ("panel",))
def lag_target(spark, sf):
    p = fx.panel(spark, sf)
    return L.lag_join(_items(spark, sf), p.select(*FT.SEGMENT, "datetime", "target"), FT.SEGMENT, "datetime",
                      ["target"], FT.TARGET_LAGS)


# --- C6/C7/D7/H11: full target family (flagship) --------------------------------
def _target_family_sql():
    ctes, joins, raw, final = G.fallback_family_sql("panel", "target", "target", FT.TARGET_LAGS, FT.SUM_LAGS)
    stat = [f"target_{h}h" for h in FT.STAT_LAGS]
    ratios = [f"{G.q(f'target{s}_{n}h')} / ({G.q(f'target{s}_{d}h')} + 0.001) AS {G.q(f'target{s}_ratio_{n}_{d}')}"
              for s, n, d in FT.RATIOS]
    raw_names = [r.split(" AS ")[-1] for r in raw]
    keep = [n for n in raw_names if not n.startswith('"_own_')]
    return (
        f"WITH {', '.join(ctes)}, j AS (SELECT {ITEM_SQL}, {', '.join(raw)} FROM panel p {' '.join(joins)}), "
        f"f AS (SELECT {', '.join(G.ITEM)}, {', '.join(keep)}, {', '.join(final)} FROM j) "
        f"SELECT *, {G.row_mean(stat)} AS target_mean, {G.row_std(stat)} AS target_std, {', '.join(ratios)} FROM f"
    )


@query("lag_fallback", _target_family_sql(), ("panel",))
def lag_fallback(spark, sf):
    return FT.target_features(_items(spark, sf), fx.panel(spark, sf))


# --- C7 / D2: lagged group sums ----------------------------------------------------
def _group_sums_lag_sql():
    ctes = ["m1 AS (SELECT datetime, county, is_business, is_consumption, sum(target) AS s FROM panel GROUP BY ALL)",
            "m2 AS (SELECT datetime, is_business, is_consumption, sum(target) AS s FROM panel GROUP BY ALL)"]
    joins, cols = [], []
    for h in FT.SUM_LAGS:
        joins += [G.lag_join("p", "m1", f"a{h}", G.LVL1, h), G.lag_join("p", "m2", f"c{h}", G.LVL2, h)]
        cols += [f"a{h}.s AS target_all_type_sum_{h}h", f"c{h}.s AS target_all_county_type_sum_{h}h"]
    return f"WITH {', '.join(ctes)} SELECT {ITEM_SQL}, {', '.join(cols)} FROM panel p {' '.join(joins)}"


@query("lag_group_sums", _group_sums_lag_sql(), ("panel",))
def lag_group_sums(spark, sf):
    p = fx.panel(spark, sf)
    by_c, all_c = L.group_levels(p, ["target"])
    out = L.lag_join(_items(spark, sf), by_c.select(*L.LEVEL_TYPE, F.col("target_sum").alias("target_all_type_sum")),
                     L.LEVEL_TYPE[1:], "datetime", ["target_all_type_sum"], FT.SUM_LAGS)
    return L.lag_join(out, all_c.select(*L.LEVEL_COUNTY_TYPE,
                                        F.col("target_sum").alias("target_all_county_type_sum")),
                      L.LEVEL_COUNTY_TYPE[1:], "datetime", ["target_all_county_type_sum"], FT.SUM_LAGS)


# --- D2 / D3: the two group levels as tables ---------------------------------------
_LEVELS_SQL = """
SELECT 'type' AS level, datetime, county, is_business, is_consumption, {agg}(target) AS target
FROM panel GROUP BY datetime, county, is_business, is_consumption
UNION ALL
SELECT 'county_type' AS level, datetime, CAST(NULL AS BIGINT) AS county, is_business, is_consumption, {agg}(target) AS target
FROM panel GROUP BY datetime, is_business, is_consumption"""


def _levels(spark, sf, which):
    by_c, all_c = L.group_levels(fx.panel(spark, sf), ["target"])
    a = by_c.select(F.lit("type").alias("level"), *L.LEVEL_TYPE, F.col(f"target_{which}").alias("target"))
    b = all_c.select(F.lit("county_type").alias("level"), "datetime", F.lit(None).cast("long").alias("county"),
                     "is_business", "is_consumption", F.col(f"target_{which}").alias("target"))
    return a.unionByName(b)


@query("group_sums", _LEVELS_SQL.format(agg="sum"), ("panel",))
def group_sums(spark, sf):
    return _levels(spark, sf, "sum")


@query("group_means", _LEVELS_SQL.format(agg="avg"), ("panel",))
def group_means(spark, sf):
    return _levels(spark, sf, "mean")


# --- D7: row mean / std over own lags (nulls skipped) --------------------------------
def _row_stats_sql():
    joins = [G.lag_join("p", "panel", f"o{h}", G.SEG, h) for h in FT.STAT_LAGS]
    cols = [f"o{h}.target AS target_{h}h" for h in FT.STAT_LAGS]
    stat = [f"target_{h}h" for h in FT.STAT_LAGS]
    return (f"WITH j AS (SELECT {ITEM_SQL}, {', '.join(cols)} FROM panel p {' '.join(joins)}) "
            f"SELECT *, {G.row_mean(stat)} AS target_mean, {G.row_std(stat)} AS target_std FROM j")


@query("row_mean_std", _row_stats_sql(), ("panel",))
def row_mean_std(spark, sf):
    p = fx.panel(spark, sf)
    out = L.lag_join(_items(spark, sf), p.select(*FT.SEGMENT, "datetime", "target"), FT.SEGMENT, "datetime",
                     ["target"], FT.STAT_LAGS)
    cols = [f"target_{h}h" for h in FT.STAT_LAGS]
    return out.withColumns({"target_mean": rowstats.row_mean(cols), "target_std": rowstats.row_std(cols)})


# --- H11: ratio features ---------------------------------------------------------------
def _ratio_sql():
    ctes, joins, raw, final = G.fallback_family_sql("panel", "target", "target", FT.TARGET_LAGS, FT.SUM_LAGS)
    ratios = [f"{G.q(f'target{s}_{n}h')} / ({G.q(f'target{s}_{d}h')} + 0.001) AS {G.q(f'target{s}_ratio_{n}_{d}')}"
              for s, n, d in FT.RATIOS]
    raw_names = [r.split(" AS ")[-1] for r in raw]
    keep = [n for n in raw_names if not n.startswith('"_own_')]
    return (f"WITH {', '.join(ctes)}, j AS (SELECT {ITEM_SQL}, {', '.join(raw)} FROM panel p {' '.join(joins)}), "
            f"f AS (SELECT {', '.join(G.ITEM)}, {', '.join(keep)}, {', '.join(final)} FROM j) "
            f"SELECT {', '.join(G.ITEM)}, {', '.join(ratios)} FROM f")


@query("ratio_features", _ratio_sql(), ("panel",))
def ratio_features(spark, sf):
    df = FT.target_features(_items(spark, sf), fx.panel(spark, sf))
    return df.select(*ITEM, *[f"target{s}_ratio_{n}_{d}" for s, n, d in FT.RATIOS])


# --- C8 / H12: same-day client join and normalised target -----------------------------------
_NORM_SQL = """
SELECT p.datetime, p.county, p.is_business, p.product_type, p.is_consumption,
  CASE WHEN coalesce(c.eic_count, 0) > 0 THEN p.target / c.eic_count ELSE p.target END AS target_per_eic,
  CASE WHEN coalesce(c.installed_capacity, 0) > 0 THEN p.target / c.installed_capacity ELSE p.target END AS target_per_capacity
FROM panel p LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business
  AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)"""


@query("normalised_target", _NORM_SQL, ("panel", "client"))
def normalised_target(spark, sf):
    return FT.normalised_target(fx.panel(spark, sf), fx.client(spark, sf))


@query("target_client_join", """
SELECT p.row_id, p.datetime, p.county, p.is_business, p.product_type, p.is_consumption, p.target,
  coalesce(c.eic_count, 0.0) AS eic_count, coalesce(c.installed_capacity, 0.0) AS installed_capacity
FROM panel p LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business
  AND c.product_type = p.product_type AND c.date = CAST(p.datetime AS DATE)""", ("panel", "client"))
def target_client_join(spark, sf):
    p = fx.panel(spark, sf).withColumn("date", F.to_date("datetime"))
    c = fx.client(spark, sf)
    j = p.join(c, on=["county", "is_business", "product_type", "date"], how="left")
    return j.select("row_id", "datetime", *FT.SEGMENT, "target",
                    F.coalesce("eic_count", F.lit(0.0)).alias("eic_count"),
                    F.coalesce("installed_capacity", F.lit(0.0)).alias("installed_capacity"))


@query("client_delayed_join", """
SELECT p.row_id, p.datetime, p.county, p.is_business, p.product_type, p.is_consumption,
  coalesce(c.installed_capacity, 0.0) AS installed_capacity, coalesce(c.eic_count, 0.0) AS eic_count
FROM panel p LEFT JOIN client c ON c.county = p.county AND c.is_business = p.is_business
  AND c.product_type = p.product_type AND c.date + INTERVAL 2 DAY = CAST(p.datetime AS DATE)""",
       ("panel", "client"))
def client_delayed_join(spark, sf):
    items = FT.with_date(_items(spark, sf))
    return FT.client_features(items, fx.client(spark, sf)).select(
        "row_id", "datetime", *FT.SEGMENT, "installed_capacity", "eic_count")


# --- C5 on normalised target ------------------------------------------------------------------
def _norm_cte():
    return f"norm AS ({_NORM_SQL})"


def _lag_norm_sql():
    joins = [G.lag_join("p", "norm", f"o{h}", G.SEG, h) for h in FT.NORM_LAGS]
    cols = [f"o{h}.target_per_eic AS target_per_eic_{h}h, o{h}.target_per_capacity AS target_per_capacity_{h}h"
            for h in FT.NORM_LAGS]
    return f"WITH {_norm_cte()} SELECT {ITEM_SQL}, {', '.join(cols)} FROM panel p {' '.join(joins)}"


@query("lag_target_norm", _lag_norm_sql(), ("panel", "client"))
def lag_target_norm(spark, sf):
    norm = FT.normalised_target(fx.panel(spark, sf), fx.client(spark, sf))
    cols = ["target_per_eic", "target_per_capacity"]
    return L.lag_join(_items(spark, sf), norm, FT.SEGMENT, "datetime", cols, FT.NORM_LAGS)


def _norm_family_sql(stats_and_ratios: bool = True):
    parts_ctes, parts_joins, parts_raw, parts_final, keep = [], [], [], [], []
    for name in ("eic", "capacity"):
        pre = f"target_per_{name}"
        ctes, joins, raw, final = G.fallback_family_sql("norm", pre, pre, FT.NORM_LAGS, FT.SUM_LAGS)
        parts_ctes += ctes
        parts_joins += joins
        parts_raw += raw
        parts_final += final
        keep += [r.split(" AS ")[-1] for r in raw if '"_own_' not in r.split(" AS ")[-1]]
    extra = []
    if stats_and_ratios:
        for name in ("eic", "capacity"):
            pre = f"target_per_{name}"
            stat = [f"{pre}_{h}h" for h in FT.STAT_LAGS]
            extra += [f"{G.row_mean(stat)} AS {pre}_mean", f"{G.row_std(stat)} AS {pre}_std"]
            extra += [f"{G.q(f'{pre}{s}_{n}h')} / ({G.q(f'{pre}{s}_{d}h')} + 0.001) AS {G.q(f'{pre}{s}_ratio_{n}_{d}')}"
                      for s, n, d in FT.RATIOS]
    tail = (", " + ", ".join(extra)) if extra else ""
    return (f"WITH {_norm_cte()}, {', '.join(parts_ctes)}, "
            f"j AS (SELECT {ITEM_SQL}, {', '.join(parts_raw)} FROM panel p {' '.join(parts_joins)}), "
            f"f AS (SELECT {', '.join(G.ITEM)}, {', '.join(keep)}, {', '.join(parts_final)} FROM j) "
            f"SELECT *{tail} FROM f")


@query("lag_fallback_norm", _norm_family_sql(), ("panel", "client"))
def lag_fallback_norm(spark, sf):
    return FT.target_norm_features(_items(spark, sf), fx.panel(spark, sf), fx.client(spark, sf))


def _norm_sums_sql():
    ctes = [f"{_norm_cte()}",
            "m1 AS (SELECT datetime, county, is_business, is_consumption, sum(target_per_eic) AS se, "
            "sum(target_per_capacity) AS sc FROM norm GROUP BY ALL)",
            "m2 AS (SELECT datetime, is_business, is_consumption, sum(target_per_eic) AS se, "
            "sum(target_per_capacity) AS sc FROM norm GROUP BY ALL)"]
    joins, cols = [], []
    for h in FT.SUM_LAGS:
        joins += [G.lag_join("p", "m1", f"a{h}", G.LVL1, h), G.lag_join("p", "m2", f"c{h}", G.LVL2, h)]
        cols += [f"a{h}.se AS target_per_eic_all_type_sum_{h}h", f"c{h}.se AS target_per_eic_all_county_type_sum_{h}h",
                 f"a{h}.sc AS target_per_capacity_all_type_sum_{h}h",
                 f"c{h}.sc AS target_per_capacity_all_county_type_sum_{h}h"]
    return f"WITH {', '.join(ctes)} SELECT {ITEM_SQL}, {', '.join(cols)} FROM panel p {' '.join(joins)}"


@query("lag_group_sums_norm", _norm_sums_sql(), ("panel", "client"))
def lag_group_sums_norm(spark, sf):
    norm = FT.normalised_target(fx.panel(spark, sf), fx.client(spark, sf))
    cols = ["target_per_eic", "target_per_capacity"]
    by_c, all_c = L.group_levels(norm, cols)
    out = _items(spark, sf)
    for lvl, keys, tag in ((by_c, L.LEVEL_TYPE, "all_type_sum"), (all_c, L.LEVEL_COUNTY_TYPE, "all_county_type_sum")):
        src = lvl.select(*keys, *[F.col(f"{c}_sum").alias(f"{c}_{tag}") for c in cols])
        out = L.lag_join(out, src, keys[1:], "datetime", [f"{c}_{tag}" for c in cols], FT.SUM_LAGS)
    return out


# --- H13 / D8: per-eic lag differences and their quantiles --------------------------------------
def _eic_fallback_sql():
    ctes, joins, raw, final = G.fallback_family_sql("norm", "target_per_eic", "target_per_eic", FT.NORM_LAGS, ())
    return (f"WITH {_norm_cte()}, {', '.join(ctes)}, "
            f"j AS (SELECT {ITEM_SQL}, {', '.join(raw)} FROM panel p {' '.join(joins)}), "
            f"f AS (SELECT {', '.join(G.ITEM)}, {', '.join(final)} FROM j)")


def _diff_names():
    return [(f"target_per_eic_diff_{d}h_lag{l}h", l, d) for l in FT.DIFF_LAGS for d in FT.DIFFS]


def _diff_sql(tail):
    diffs = ", ".join(f"target_per_eic_{l}h - target_per_eic_{l + d}h AS {n}" for n, l, d in _diff_names())
    return f"{_eic_fallback_sql()}, g AS (SELECT {', '.join(G.ITEM)}, {diffs} FROM f) {tail}"


def _eic_diffs(spark, sf):
    norm = FT.normalised_target(fx.panel(spark, sf), fx.client(spark, sf))
    out = L.lag_fallback(_items(spark, sf), norm, "target_per_eic", FT.NORM_LAGS)
    return out.select(*ITEM, *[(F.col(f"target_per_eic_{l}h") - F.col(f"target_per_eic_{l + d}h")).alias(n)
                               for n, l, d in _diff_names()])


@query("lag_diffs", _diff_sql("SELECT * FROM g"), ("panel", "client"))
def lag_diffs(spark, sf):
    return _eic_diffs(spark, sf)


def _quantile_tail(method):
    items = []
    for d in FT.DIFFS:
        cols = [f"target_per_eic_diff_{d}h_lag{l}h" for l in FT.DIFF_LAGS]
        items.append(f"{G.row_quantile_linear(cols, 0.5)} AS target_per_eic_diff_{d}h_median")
        for p, tag in ((0.25, "q25"), (0.75, "q75")):
            fn = G.row_quantile_nearest if method == "nearest" else G.row_quantile_linear
            items.append(f"{fn(cols, p)} AS target_per_eic_diff_{d}h_{tag}")
    return f"SELECT {', '.join(G.ITEM)}, {', '.join(items)} FROM g"


def _quantiles(spark, sf, method):
    df = _eic_diffs(spark, sf)
    out = {}
    for d in FT.DIFFS:
        cols = [f"target_per_eic_diff_{d}h_lag{l}h" for l in FT.DIFF_LAGS]
        out[f"target_per_eic_diff_{d}h_median"] = rowstats.row_median(cols)
        out[f"target_per_eic_diff_{d}h_q25"] = rowstats.row_quantile(cols, 0.25, method)
        out[f"target_per_eic_diff_{d}h_q75"] = rowstats.row_quantile(cols, 0.75, method)
    return df.select(*ITEM, *[v.alias(k) for k, v in out.items()])


@query("row_quantiles_nearest", _diff_sql(_quantile_tail("nearest")), ("panel", "client"))
def row_quantiles_nearest(spark, sf):
    return _quantiles(spark, sf, "nearest")


@query("row_quantiles_linear", _diff_sql(_quantile_tail("linear")), ("panel", "client"))
def row_quantiles_linear(spark, sf):
    return _quantiles(spark, sf, "linear")


# --- B4: look-back pruning of a source by the items' earliest time ------------------------------
@query("lookback_prune", """
SELECT h.* FROM hist_weather h
WHERE h.datetime >= (SELECT min(datetime) FROM panel WHERE datetime >= TIMESTAMP '2024-01-20') - INTERVAL 360 HOUR""",
       ("panel", "hist_weather"))
def lookback_prune(spark, sf):
    items = fx.panel(spark, sf).filter(F.col("datetime") >= F.lit("2024-01-20").cast("timestamp"))
    start = L.lookback_min(items, "datetime")
    return L.lookback_prune(fx.hist_weather(spark, sf), "datetime", start, 360)

