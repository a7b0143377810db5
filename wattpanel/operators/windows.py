"""Window operators that stay skew-safe: no window is partitioned by a bare group key.

Sliding calendar sums go through ``window()`` (Expand + partial aggregation);
per-group ordered windows are chunked by time (or by global row index) and get a
halo of preceding rows, so one task holds at most one chunk of one group.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast, cut_lineage


def sliding_sum(df: DataFrame, keys: Sequence[str], ts: str, col: str, period: str, every: str, out: str,
                min_start=None) -> DataFrame:
    """Sum per key over windows of ``period`` every ``every``, labelled by the right edge.

    Windows are left-closed ``[end - period, end)``.  All overlapping windows are
    emitted (Q9); ``min_start`` drops windows that start before a given time.
    """
    g = df.groupBy(*keys, F.window(ts, period, every).alias("_w")).agg(F.sum(col).alias(out))
    if min_start is not None:
        g = g.filter(F.col("_w.start") >= F.lit(min_start))
    return g.select(*keys, F.col("_w.end").alias(ts), out)


def _epoch_seconds(ts: str) -> F.Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


class Rolling(NamedTuple):
    """A sum of ``col`` over ``(t - seconds, t]``; with ``shift`` the sum at the row exactly ``shift`` seconds earlier (null if there is none)."""

    col: str
    seconds: int
    out: str
    shift: int = 0
    fill_null: float | None = 0.0


def rolling_sums_time(df: DataFrame, keys: Sequence[str], ts: str, sums: Sequence[Rolling], chunk_seconds: int = 30 * 86400) -> DataFrame:
    """Several time-rolling sums per key, at every row, as frames of one window.

    Time is cut into chunks of ``chunk_seconds``; each chunk also receives the
    rows of the longest frame before it (its halo), so the window runs per
    (key, chunk) and a hot key is spread over many tasks.
    """
    reach = max(int(s.seconds) + int(s.shift) for s in sums)
    chunk = max(chunk_seconds, reach)
    base = df.withColumn("_t", _epoch_seconds(ts)).withColumn("_chunk", F.floor(F.col("_t") / chunk))
    # A row also belongs to the next chunk when it lies within reach of that chunk's start.
    nxt = F.col("_chunk") + 1
    in_halo = F.col("_t") > nxt * chunk - reach
    copies = base.select("*", F.explode(F.when(in_halo, F.array(F.lit(False), F.lit(True)))
                                        .otherwise(F.array(F.lit(False)))).alias("_halo"))
    copies = copies.withColumn("_chunk", F.when(F.col("_halo"), nxt).otherwise(F.col("_chunk")))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t")
    values = {}
    for s in sums:
        value = F.sum(s.col).over(w.rangeBetween(-(int(s.seconds) + int(s.shift) - 1), -int(s.shift)))
        if s.shift:
            value = F.when(F.count("_t").over(w.rangeBetween(-int(s.shift), -int(s.shift))) > 0, value)
        values[s.out] = value if s.fill_null is None else F.coalesce(value, F.lit(s.fill_null))
    return copies.withColumns(values).filter(~F.col("_halo")).drop("_t", "_chunk", "_halo")


def rolling_sum_time(df: DataFrame, keys: Sequence[str], ts: str, col: str, seconds: int, out: str,
                     chunk_seconds: int = 30 * 86400, fill_null: float | None = 0.0) -> DataFrame:
    """Sum of ``col`` over ``(t - seconds, t]`` per key, at every row."""
    return rolling_sums_time(df, keys, ts, [Rolling(col, seconds, out, fill_null=fill_null)], chunk_seconds)


def ffill_limit(df: DataFrame, keys: Sequence[str], ts: str, col: str, passes: int = 1,
                chunk_days: int = 7) -> DataFrame:
    """Forward fill with limit 1 per key, repeated ``passes`` times.

    A null takes the value of the previous row of its key (by ``ts``).  Rows are
    windowed per (key, time chunk); the first row of a chunk takes the last row of
    the nearest earlier non-empty chunk, found on the small (key x chunk) table.
    """
    chunk = F.floor(_epoch_seconds(ts) / (chunk_days * 86400))
    out = df.withColumn("_chunk", chunk)
    for _ in range(passes):
        w = Window.partitionBy(*keys, "_chunk").orderBy(ts)
        out = out.withColumn("_prev", F.lag(col, 1).over(w)).withColumn("_first", F.row_number().over(w) == 1)
        last = out.groupBy(*keys, "_chunk").agg(F.max_by(F.col(col), F.col(ts)).alias("_last"))
        wk = Window.partitionBy(*keys).orderBy("_chunk")
        carry = last.select(*keys, "_chunk", F.lag("_last", 1).over(wk).alias("_carry"))
        out = out.join(carry, on=[*keys, "_chunk"], how="left")
        prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
        out = out.withColumn(col, F.coalesce(F.col(col), prev)).drop("_prev", "_first", "_carry")
    return out.drop("_chunk")


def global_row_index(df: DataFrame, order: Sequence[str], out: str = "_idx", partitions: int | None = None
                     ) -> DataFrame:
    """0-based position of each row in a total order, without a one-task sort.

    Range-partition on the order, number rows inside each partition, add the
    partition's offset (a table with one row per partition).  The numbered frame
    is checkpointed so both passes see the same partitioning.
    """
    n = partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = df.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    numbered = cut_lineage(ranged.withColumn("_pid", F.spark_partition_id())
                           .withColumn("_mid", F.monotonically_increasing_id()))
    counts = numbered.groupBy("_pid").agg(F.count("*").alias("_cnt"), F.min("_mid").alias("_first"))
    offs = counts.withColumn("_off", F.sum("_cnt").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).fillna({"_off": 0})
    j = numbered.join(bounded_broadcast(offs.select("_pid", "_off", "_first"), 1_000_000), "_pid")
    return j.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first")).cast("long")).drop(
        "_pid", "_mid", "_off", "_first")


def rolling_rows_by_value(df: DataFrame, order: Sequence[str], value: str, n: int,
                          stats: Sequence[str] = ("mean", "max", "median", "q25", "q75"),
                          bucket_rows: int = 100_000, prefix: str = "rolling") -> DataFrame:
    """Statistics over the last ``n`` rows of one global order, null until ``n`` rows.

    Rows get a global index; buckets of ``bucket_rows`` consecutive rows each also
    receive the ``n - 1`` rows before them, so every frame lies inside one bucket.
    """
    bucket_rows = max(bucket_rows, n)  # a halo reaches into one bucket
    idx = global_row_index(df, order, "_idx")
    b = F.floor(F.col("_idx") / bucket_rows)
    halo = (F.col("_idx") % bucket_rows) >= bucket_rows - (n - 1)
    c = idx.withColumn("_b", b).select(
        "*", F.explode(F.when(halo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
        .alias("_halo"))
    c = c.withColumn("_b", F.when(F.col("_halo"), F.col("_b") + 1).otherwise(F.col("_b")))
    w = Window.partitionBy("_b").orderBy("_idx").rowsBetween(-(n - 1), 0)
    full = F.count(value).over(w) >= n
    exprs = {
        "mean": F.avg(value).over(w),
        "max": F.max(value).over(w),
        "median": F.percentile(value, 0.5).over(w),
        "q25": F.percentile(value, 0.25).over(w),
        "q75": F.percentile(value, 0.75).over(w),
    }
    cols = {f"{prefix}_{s}": F.when(full & (F.col("_idx") >= n - 1), exprs[s]) for s in stats}
    return c.withColumns(cols).filter(~F.col("_halo")).drop("_b", "_halo")


def every_kth(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Keep rows 0, k, 2k, ... of a global order (E5), via the partition-offset index."""
    return global_row_index(df, order, "_idx").filter(F.col("_idx") % k == 0).drop("_idx")


def minmax_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min), null when the column is constant."""
    mm = df.agg(F.min(col).alias("_mn"), F.max(col).alias("_mx")).first()
    mn, mx = mm["_mn"], mm["_mx"]
    rng = None if mn is None or mx == mn else (mx - mn)
    expr = (F.col(col) - F.lit(mn)) / F.lit(rng) if rng else F.lit(None).cast("double")
    return df.withColumn(out or f"{col}_scaled", expr)
