"""Step-by-step inference as a stream (survey section 3.3).

Items arrive as files whose rows carry the number of their data block (one step of the
reference's loop); a micro-batch may hold many blocks.  Blocks without a currently scored row get zeros and no features;
for the others the same batch feature functions run with their look-back over the history tables,
forecast columns are swapped in for the historical ones, the model scores, and
the sentinel guard is applied block by block.  Results go to a Parquet log partitioned by batch
id (idempotent on replay).

``run_inference`` scores against tables that stand still; ``run_refreshed`` gets the tables' new rows in the same
stream and folds each block's rows into their states before it scores the block's items.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import swap_hist_forecast
from ..session import bounded_broadcast, cut_lineage
from .feeds import BLOCK, MAX_FLAGS, append_state, compact, guard_predictions, read_steps, run_to_log, state_view


def run_inference(spark: SparkSession, items: DataFrame, log_dir: str, checkpoint: str,
                  build: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame],
                  keys: Sequence[str] = ("row_id",), flag: str = "currently_scored", block: str = BLOCK) -> DataFrame:
    """Drain the stream ``items``; returns the emitted predictions (keys, block, target)."""

    def step(batch: DataFrame, _id: int) -> DataFrame:
        needed = batch.groupBy(block).agg(F.coalesce(F.bool_or(F.col(flag)), F.lit(False)).alias("_needed"))
        tagged = batch.join(bounded_broadcast(needed, MAX_FLAGS), block)
        idle = tagged.filter("not _needed").select(*keys, block, F.lit(0.0).alias("target"))
        active = tagged.filter("_needed").drop("_needed")
        if active.isEmpty():
            return idle
        scored = cut_lineage(score(swap_hist_forecast(build(active))).select(*keys, block, flag, "prediction"))
        return idle.unionByName(guard_predictions(scored, "prediction", flag, [block]).select(*keys, block, "target"))

    run_to_log(items, log_dir, checkpoint, step)
    return spark.read.parquet(log_dir).drop("batch_id")


Tables = Mapping[str, DataFrame]


def run_refreshed(spark: SparkSession, feed_root: str, state_root: str, checkpoint: str, schemas: Mapping[str, T.StructType],
                  keys: Mapping[str, Sequence[str]], build: Callable[[DataFrame, Tables], DataFrame], score: Callable[[DataFrame], DataFrame],
                  items: str = "items", item_keys: Sequence[str] = ("row_id",), flag: str = "currently_scored", block: str = BLOCK,
                  files_per_trigger: int | None = None, compact_every: int = 16) -> DataFrame:
    """Refresh all tables, then score, block by block in order (A6, I2, I3); returns the emitted predictions.

    ``schemas`` names the feeds under ``feed_root``: the tables of ``keys`` and the items.  Of every micro-batch the blocks are
    taken in order: the block's table rows go to the table states under ``state_root``, then its items are built and scored
    against the states as of that block, and guarded.  A block without a scored item gets zeros and no features.  A batch that is
    replayed overwrites what it wrote, and the states are read as of the block, so it emits the same rows again.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        blocks = sorted(r[0] for r in batch.select(block).distinct().collect())  # the steps of one micro-batch
        for i, b in enumerate(blocks):
            now = batch.filter(F.col(block) == b)
            for name in keys:
                append_state(now.filter(F.col("feed") == name).select(f"{name}.*"), batch_id, f"{state_root}/{name}", i)
            asked = now.filter(F.col("feed") == items).select(f"{items}.*")
            needed = asked.agg(F.bool_or(F.col(flag))).first()[0]
            if needed is None and asked.isEmpty():
                continue
            if not needed:
                out = asked.select(*item_keys, block, F.lit(0.0).alias("target"))
            else:
                tables = {name: state_view(spark, f"{state_root}/{name}", schemas[name], cols, block, as_of=b) for name, cols in keys.items()}
                scored = cut_lineage(score(swap_hist_forecast(build(asked, tables))).select(*item_keys, block, flag, "prediction"))
                out = guard_predictions(scored, "prediction", flag, [block]).select(*item_keys, block, "target")
            append_state(out, batch_id, f"{state_root}/predictions", i)
        batch.unpersist()
        if (batch_id + 1) % compact_every == 0:
            for name, cols in keys.items():
                compact(spark, f"{state_root}/{name}", schemas[name], cols, batch_id, block)

    q = (read_steps(spark, feed_root, schemas, files_per_trigger, block).writeStream.foreachBatch(step)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{state_root}/predictions/log").drop("batch_id", "step")
