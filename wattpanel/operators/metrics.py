"""Errors, baselines and summary statistics.

Exact quantiles, global or per group, come from counts of distinct values in a distributed order
(range partitioning and partition offsets) instead of an aggregation buffer holding every
value of a group: neither a group nor a tied value with a third of all rows lands in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def abs_err(pred, y) -> F.Column:
    p = F.col(pred) if isinstance(pred, str) else pred
    t = F.col(y) if isinstance(y, str) else y
    return F.abs(p - t)


def _value_counts(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """keys, _v, _c and _upto: the distinct values of each group with their counts, and the rows up to and including each in
    the global order (keys, value).

    Equal values are counted before anything is ordered, so ties (however many) are one row.
    """
    vals = df.select(*keys, F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, "_v"]
    parts = cut_lineage(counted.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    before = parts.groupBy("_pid").agg(F.sum("_c").alias("_s")).withColumn(
        "_off", F.coalesce(F.sum("_s").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum("_c").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_run", run).join(F.broadcast(before.select("_pid", "_off")), "_pid").select(  # a row a partition
        *keys, "_v", "_c", (F.col("_run") + F.col("_off")).alias("_upto"))


def _at_rank(rank: F.Column, lo: F.Column, hi: F.Column) -> F.Column:
    return F.max(F.when((lo <= rank) & (rank <= hi), F.col("_v")))


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float]) -> list[float | None]:
    """Linear-interpolated quantiles of the non-null values (pandas/NumPy default)."""
    counts = cut_lineage(_value_counts(df, [], col))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    if n == 0:
        return [None for _ in qs]
    lo, hi = F.col("_upto") - F.col("_c"), F.col("_upto") - 1
    spots = [(n - 1) * q for q in qs]
    row = counts.agg(*[_at_rank(F.lit(f(p)), lo, hi) for p in spots for f in (math.floor, math.ceil)]).first()
    return [row[2 * i] + (p - math.floor(p)) * (row[2 * i + 1] - row[2 * i]) for i, p in enumerate(spots)]


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where null equals null; the left side's key columns stay."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def grouped_exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, qs: Sequence[float],
                            names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles of ``col`` per group, without one buffer per group.

    Distinct values are counted and numbered in the global order (keys, value), so neither a hot group
    nor a hot value lands in one task; a group's wanted ranks are picked by a partial aggregate.
    Null keys are a group.  Returns keys + one column per quantile.
    """
    names = list(names or [f"q{int(round(q * 100))}" for q in qs])
    counts = cut_lineage(_value_counts(df, keys, col))
    groups = counts.groupBy(*keys).agg(F.min(F.col("_upto") - F.col("_c")).alias("_start"), F.sum("_c").alias("_n"))
    rows = null_safe(counts, groups, keys, "inner")
    lo, hi = F.col("_upto") - F.col("_c") - F.col("_start"), F.col("_upto") - 1 - F.col("_start")
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        aggs += [_at_rank(F.floor(pos), lo, hi).alias(f"_a{i}"), _at_rank(F.ceil(pos), lo, hi).alias(f"_b{i}"), F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    picked = rows.groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *[(F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(x) for i, x in enumerate(names)])


def quantile_filter(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """Rows strictly above each column's own q-quantile."""
    cond = F.lit(True)
    for c in cols:
        (v,) = exact_quantiles(df, c, [q])
        cond = cond & (F.col(c) > F.lit(v))
    return df.filter(cond)


def slope_through_origin(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), out: str = "slope") -> DataFrame:
    """Least squares y = k x with k >= 0: greatest(0, sum(xy) / sum(xx))."""
    k = F.try_divide(F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x)))
    agg = F.greatest(F.lit(0.0), k).alias(out)
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def describe(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, 25%, 50%, 75%, max."""
    c = F.col(col)
    aggs = [F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
            F.max(c).alias("max")]
    if not keys:
        q25, q50, q75 = exact_quantiles(df, col, [0.25, 0.5, 0.75])
        return df.agg(*aggs).withColumns({"q25": F.lit(q25), "q50": F.lit(q50), "q75": F.lit(q75)})
    moments = df.groupBy(*keys).agg(*aggs)
    qs = grouped_exact_quantiles(df, keys, col, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return null_safe(moments, qs, keys, "left")


def group_mae(df: DataFrame, keys: Sequence[str], pred: str, y: str, out: str = "mae") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(abs_err(pred, y)).alias(out), F.count("*").alias("n"))


def weighted_score(scores: DataFrame, score: str = "mae", n: str = "n") -> DataFrame:
    """Group-size-weighted score sum(score * n) / sum(n)."""
    return scores.agg((F.sum(F.col(score) * F.col(n)) / F.sum(n)).alias("score"))


def worst_groups(df: DataFrame, keys: Sequence[str], pred: str, y: str, q: float = 0.75
                 ) -> tuple[DataFrame, DataFrame]:
    """Groups with MAE >= the q-quantile of group MAEs, and the rows of the worst group.

    The rows and the group table, one row per group, are made once and checkpointed; the worst group is a top-1 with the keys
    as tie-break, joined back with a semi join.
    """
    df = cut_lineage(df)
    g = cut_lineage(group_mae(df, keys, pred, y))
    (thr,) = exact_quantiles(g, "mae", [q])
    high = g.filter(F.col("mae") >= F.lit(thr))
    worst = high.orderBy(F.col("mae").desc(), *keys).limit(1).select(*keys)
    top = F.broadcast(worst.select(*[F.col(k).alias(f"_w_{k}") for k in keys]))  # one row
    rows = df.join(top, [df[k].eqNullSafe(F.col(f"_w_{k}")) for k in keys], "left_semi")
    return high, rows


def segment_median_baseline(train: DataFrame, val: DataFrame, segment: str, y: str) -> DataFrame:
    """Per-segment median of the training target joined to validation rows."""
    med = grouped_exact_quantiles(train, [segment], y, [0.5], ["pred"])
    return null_safe(val, med, [segment], "inner")
