"""Errors, baselines, summaries, folds, splits and ordered-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds as K
from ..operators import lags as L
from ..operators import metrics as M
from ..operators import windows as W
from ..session import cut_lineage
from ..sources import fixtures as fx
from ..sources.io import read_table
from . import features as FT
from . import sqlgen as G
from .q_weather import FCW_CTE, HCW_CTE, WX_FIX, county_forecast, county_hist
from .registry import query

SEG = FT.SEGMENT
KEYS6 = ["row_id", *SEG, "datetime"]


# Evaluation frame: the target and two lag predictions (48 h and 168 h, with fallback); rows without both dropped.
def _ev_sql():
    ctes, joins, raw, final = G.fallback_family_sql("panel", "target", "target", [48, 168], ())
    cols = ", ".join(f"p.{c}" for c in G.ITEM)
    return (f"{', '.join(ctes)}, j AS (SELECT {cols}, p.target, {', '.join(raw)} FROM panel p {' '.join(joins)}), "
            f"ev0 AS (SELECT {', '.join(G.ITEM)}, target, {', '.join(final)} FROM j), "
            f"ev AS (SELECT {', '.join(G.ITEM)}, target, target_48h AS p48, target_168h AS p168 FROM ev0 "
            f"WHERE target_48h IS NOT NULL AND target_168h IS NOT NULL)")


EV = _ev_sql()


def eval_frame(spark, sf):
    p = cut_lineage(fx.panel(spark, sf))
    e = L.lag_fallback(p, p, "target", [48, 168])
    e = e.select(*KEYS6, "target", F.col("target_48h").alias("p48"), F.col("target_168h").alias("p168"))
    return e.na.drop(subset=["p48", "p168"])


@query("mae_by_route", f"""WITH {EV}
SELECT avg(CASE WHEN is_consumption = 0 THEN abs(p48 - target) END) AS production_1,
  avg(CASE WHEN is_consumption = 0 THEN abs(p168 - target) END) AS production_2,
  avg(CASE WHEN is_consumption = 1 THEN abs(p48 - target) END) AS consumption,
  avg(abs(CASE WHEN is_consumption = 0 THEN p168 ELSE p48 END - target)) AS total
FROM ev""", ("panel",))
def mae_by_route(spark, sf):
    e = eval_frame(spark, sf)
    prod, cons = F.col("is_consumption") == 0, F.col("is_consumption") == 1
    routed = F.when(prod, F.col("p168")).otherwise(F.col("p48"))
    return e.agg(F.avg(F.when(prod, M.abs_err("p48", "target"))).alias("production_1"),
                 F.avg(F.when(prod, M.abs_err("p168", "target"))).alias("production_2"),
                 F.avg(F.when(cons, M.abs_err("p48", "target"))).alias("consumption"),
                 F.avg(M.abs_err(routed, "target")).alias("total"))


_FOLD_DATES = ["2024-01-15", "2024-01-22"]


@query("fold_mae", f"""WITH {EV},
f AS (SELECT 'f-2024-1-15' AS fold, avg(abs(p48 - target)) AS mae FROM ev WHERE datetime > TIMESTAMP '2024-01-15'
      UNION ALL SELECT 'f-2024-1-22', avg(abs(p48 - target)) FROM ev WHERE datetime > TIMESTAMP '2024-01-22')
SELECT * FROM f UNION ALL SELECT 'mean', avg(mae) FROM f""", ("panel",))
def fold_mae(spark, sf):
    folds = K.date_folds(_FOLD_DATES)
    e = eval_frame(spark, sf).withColumn("_folds", K.fold_mask(folds))
    per = K.per_fold(e, folds, {"mae": M.abs_err("p48", "target")}).select("fold", F.col("mean").alias("mae"))
    return per.unionByName(per.agg(F.lit("mean").alias("fold"), F.avg("mae").alias("mae")))


# Baselines learn from the first two thirds of the data's span.
_TRAIN_SHARE = 2 / 3
_CUT_SQL = f"""cut AS (SELECT date_trunc('hour', make_timestamp(CAST((lo + floor((hi - lo) * {_TRAIN_SHARE!r})) * 1000000 AS BIGINT))) AS cut_at
  FROM (SELECT epoch(min(datetime)) AS lo, epoch(max(datetime)) AS hi FROM ev))"""


def _baseline_split(e):
    cut = F.lit(K.fraction_cuts(e, [_TRAIN_SHARE])[0]).cast("timestamp")
    return e.filter(F.col("datetime") <= cut), e.filter(F.col("datetime") > cut)


@query("baseline_constants", f"""WITH {EV}, {_CUT_SQL},
tr AS (SELECT ev.* FROM ev, cut WHERE datetime <= cut_at), va AS (SELECT ev.* FROM ev, cut WHERE datetime > cut_at),
c AS (SELECT quantile_cont(target, 0.5) AS med, avg(target) AS mean FROM tr)
SELECT avg(abs(0.0 - target)) AS mae_zero, avg(abs(c.med - target)) AS mae_median, avg(abs(c.mean - target)) AS mae_mean,
  any_value(c.med) AS median, any_value(c.mean) AS mean
FROM va, c""", ("panel",))
def baseline_constants(spark, sf):
    train, val = _baseline_split(cut_lineage(eval_frame(spark, sf)))
    (med,) = M.exact_quantiles(train, "target", [0.5])
    mean = train.agg(F.avg("target")).first()[0]
    t = F.col("target")
    return val.agg(F.avg(F.abs(F.lit(0.0) - t)).alias("mae_zero"), F.avg(F.abs(F.lit(med) - t)).alias("mae_median"),
                   F.avg(F.abs(F.lit(mean) - t)).alias("mae_mean"), F.lit(med).alias("median"),
                   F.lit(mean).alias("mean"))


_SEG_SQL = "CAST(county AS VARCHAR) || '_' || CAST(is_business AS VARCHAR) || '_' || CAST(product_type AS VARCHAR) || '_' || CAST(is_consumption AS VARCHAR)"


@query("baseline_segment_median", f"""WITH {EV}, {_CUT_SQL},
tr AS (SELECT {_SEG_SQL} AS segment, target FROM ev, cut WHERE datetime <= cut_at),
va AS (SELECT {_SEG_SQL} AS segment, target FROM ev, cut WHERE datetime > cut_at),
m AS (SELECT segment, quantile_cont(target, 0.5) AS pred FROM tr GROUP BY segment)
SELECT segment, any_value(pred) AS median, count(*) AS n, avg(abs(pred - target)) AS mae FROM va JOIN m USING (segment)
GROUP BY segment""", ("panel",))
def baseline_segment_median(spark, sf):
    train, val = _baseline_split(cut_lineage(eval_frame(spark, sf).withColumn("segment", S.segment_key(SEG))))
    j = M.segment_median_baseline(train, val, "segment", "target")
    return j.groupBy("segment").agg(F.first("pred").alias("median"), F.count("*").alias("n"),
                                    F.avg(M.abs_err("pred", "target")).alias("mae"))


@query("describe_stats", """
SELECT is_consumption, count(target) AS count, avg(target) AS mean, stddev_samp(target) AS std, min(target) AS min,
  quantile_cont(target, 0.25) AS q25, quantile_cont(target, 0.5) AS q50, quantile_cont(target, 0.75) AS q75,
  max(target) AS max
FROM panel GROUP BY is_consumption""", ("panel",))
def describe_stats(spark, sf):
    return M.describe(fx.panel(spark, sf), "target", ["is_consumption"])


_SNOW_SQL = f"""{HCW_CTE}, {FCW_CTE},
sn AS (SELECT h.county, h.datetime, h.snowfall AS snowfall_historical, f.snowfall AS snowfall_forecast
  FROM hcw h JOIN fcw f USING (county, datetime)),
hi AS (SELECT * FROM sn WHERE snowfall_historical > (SELECT quantile_cont(snowfall_historical, 0.9) FROM sn)
  AND snowfall_forecast > (SELECT quantile_cont(snowfall_forecast, 0.9) FROM sn))"""


def _snow(spark, sf):
    sw = fx.station_weights(spark, sf)
    h, _ = county_hist(spark, sf, sw)
    f, _ = county_forecast(spark, sf, sw)
    return h.select("county", "datetime", F.col("snowfall").alias("snowfall_historical")).join(
        f.select("county", "datetime", F.col("snowfall").alias("snowfall_forecast")), ["county", "datetime"])


@query("quantile_filter", f"WITH {_SNOW_SQL} SELECT * FROM hi", WX_FIX)
def quantile_filter(spark, sf):
    return M.quantile_filter(_snow(spark, sf), ["snowfall_historical", "snowfall_forecast"], 0.9)


@query("slope_origin", f"""WITH {_SNOW_SQL}
SELECT greatest(0.0, sum(snowfall_forecast * 1000 * snowfall_historical) / sum((snowfall_forecast * 1000) * (snowfall_forecast * 1000))) AS slope
FROM hi""", WX_FIX)
def slope_origin(spark, sf):
    hi = M.quantile_filter(_snow(spark, sf), ["snowfall_historical", "snowfall_forecast"], 0.9)
    return M.slope_through_origin(hi.withColumn("x", F.col("snowfall_forecast") * 1000), "x", "snowfall_historical")


@query("worst_groups", f"""WITH {EV},
g AS (SELECT county, is_business, product_type, is_consumption, avg(abs(p48 - target)) AS mae FROM ev GROUP BY ALL),
w AS (SELECT * FROM g WHERE mae >= (SELECT quantile_cont(mae, 0.75) FROM g)
  ORDER BY mae DESC, county, is_business, product_type, is_consumption LIMIT 1)
SELECT ev.row_id, ev.datetime, ev.target, ev.p48 FROM ev SEMI JOIN w USING (county, is_business, product_type, is_consumption)""",
       ("panel",))
def worst_groups(spark, sf):
    _, rows = M.worst_groups(eval_frame(spark, sf), SEG, "p48", "target", 0.75)
    return rows.select("row_id", "datetime", "target", "p48")


@query("weighted_score", f"""WITH {EV},
g AS (SELECT product_type, avg(abs(p48 - target)) AS mae, count(*) AS n FROM ev GROUP BY product_type)
SELECT sum(mae * n) / sum(n) AS score FROM g""", ("panel",))
def weighted_score(spark, sf):
    return M.weighted_score(M.group_mae(eval_frame(spark, sf), ["product_type"], "p48", "target"))


@query("distinct_units", "SELECT DISTINCT county, is_business, product_type FROM panel", ("panel",))
def distinct_units(spark, sf):
    return fx.panel(spark, sf).select("county", "is_business", "product_type").distinct()


@query("temporal_folds", """
SELECT row_id, 'f-2024-1-10' AS fold, CASE WHEN datetime <= TIMESTAMP '2024-01-10' THEN 'train' ELSE 'val' END AS role FROM panel
UNION ALL
SELECT row_id, 'f-2024-1-20', CASE WHEN datetime <= TIMESTAMP '2024-01-20' THEN 'train' ELSE 'val' END FROM panel""",
       ("panel",))
def temporal_folds(spark, sf):
    return K.temporal_folds(fx.panel(spark, sf), ["2024-01-10", "2024-01-20"]).select("row_id", "fold", "role")


_MONTHS = ["1996-03", "1998-07", "2000-12"]


def _month_sql():
    parts = []
    for name, a, b in K.month_intervals(_MONTHS, 0):
        parts.append(f"SELECT l_orderkey, l_linenumber, '{name}' AS fold, CASE WHEN l_shipdate BETWEEN TIMESTAMP '{a}' "
                     f"AND TIMESTAMP '{b}' THEN 'val' ELSE 'train' END AS role FROM lineitem")
    return " UNION ALL ".join(parts)


@query("monthly_folds", _month_sql())
def monthly_folds(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return K.monthly_folds(li, _MONTHS, 0, "l_shipdate").select("l_orderkey", "l_linenumber", "fold", "role")


@query("segment_tail_split", """
WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS date FROM lineitem),
b AS (SELECT l_suppkey, min(date) AS f, max(date) AS l FROM d GROUP BY l_suppkey)
SELECT l_orderkey, l_linenumber, CASE WHEN (b.l - b.f) >= 200 AND d.date >= b.l - INTERVAL 100 DAY THEN 'val' ELSE 'train' END AS role
FROM d JOIN b USING (l_suppkey)""")
def segment_tail_split(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey",
                                                  F.to_date("l_shipdate").alias("date"))
    return K.segment_tail_split(li, ["l_suppkey"], "date", 100).select("l_orderkey", "l_linenumber", "role")


@query("date_split", """
SELECT 'train' AS role, row_id FROM panel WHERE datetime < TIMESTAMP '2024-01-15'
UNION ALL SELECT 'val', row_id FROM panel WHERE datetime > TIMESTAMP '2024-01-15'""", ("panel",))
def date_split(spark, sf):
    tr, va = K.date_split(fx.panel(spark, sf), "2024-01-15 00:00:00")
    return tr.select(F.lit("train").alias("role"), "row_id").unionByName(va.select(F.lit("val").alias("role"), "row_id"))


_ORDER = ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_ORDER_SQL = ", ".join(_ORDER)


@query("every_kth", f"""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (ORDER BY {_ORDER_SQL}) AS rn FROM lineitem) WHERE (rn - 1) % 10 = 0""")
def every_kth(spark, sf):
    li = read_table(spark, sf, "lineitem").select(*_ORDER)
    return W.every_kth(li, _ORDER, 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("minmax_scale", """
SELECT l_orderkey, l_linenumber, (l_extendedprice - min(l_extendedprice) OVER ()) /
  nullif(max(l_extendedprice) OVER () - min(l_extendedprice) OVER (), 0) AS l_extendedprice_scaled
FROM lineitem""")
def minmax_scale(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return W.minmax_scale(li, "l_extendedprice").drop("l_extendedprice")


_N = 50


@query("rolling_rows_by_feature", f"""
WITH w AS (SELECT l_orderkey, l_linenumber, row_number() OVER o AS rn, count(l_quantity) OVER f AS c,
  avg(l_quantity) OVER f AS a, max(l_quantity) OVER f AS mx, quantile_cont(l_quantity, 0.5) OVER f AS md,
  quantile_cont(l_quantity, 0.25) OVER f AS q1, quantile_cont(l_quantity, 0.75) OVER f AS q3
  FROM lineitem WINDOW o AS (ORDER BY {_ORDER_SQL}), f AS (ORDER BY {_ORDER_SQL} ROWS BETWEEN {_N - 1} PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_linenumber,
  CASE WHEN c >= {_N} AND rn >= {_N} THEN a END AS rolling_mean, CASE WHEN c >= {_N} AND rn >= {_N} THEN mx END AS rolling_max,
  CASE WHEN c >= {_N} AND rn >= {_N} THEN md END AS rolling_median, CASE WHEN c >= {_N} AND rn >= {_N} THEN q1 END AS rolling_q25,
  CASE WHEN c >= {_N} AND rn >= {_N} THEN q3 END AS rolling_q75
FROM w""")
def rolling_rows_by_feature(spark, sf):
    li = read_table(spark, sf, "lineitem").select(*_ORDER, "l_quantity")
    out = W.rolling_rows_by_value(li, _ORDER, "l_quantity", _N, bucket_rows=20_000)
    return out.select("l_orderkey", "l_linenumber", "rolling_mean", "rolling_max", "rolling_median", "rolling_q25",
                      "rolling_q75")


@query("mean_by_value", """
SELECT l_quantity, avg(l_extendedprice) AS mean_extendedprice FROM lineitem GROUP BY l_quantity""")
def mean_by_value(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("mean_extendedprice"))
