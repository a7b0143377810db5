"""Micro-batch refresh with Structured Streaming.

The reference loops over arriving frames, upserts them into in-memory tables and
rebuilds features and scores for the new rows.  Here each table arrives as a file
stream whose rows carry the number of their data block; ``foreachBatch`` appends every micro-batch
to a Parquet log partitioned by batch id (overwriting its own partition, so a replay after a failure is
harmless), and readers see the log through a latest-block-wins view.  ``compact`` folds a state's log into a snapshot, so
that readers touch the snapshot and the batches after it only.  A micro-batch may hold many files and many blocks.  The caller names feed, log and checkpoint folders: a job started again with the same
three goes on where it stopped.  Feature and score refreshes
are stateless ``foreachBatch`` jobs that call the same batch functions, with the
look-back read from the logs; only de-duplication and the live sliding sum keep
operator state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import latest_per_key
from ..schemas import KEYS
from ..session import bounded_broadcast, remove_dir

BLOCK = "data_block_id"
MAX_FLAGS = 1_000_000  # batch flags broadcast at most


def guard_predictions(df: DataFrame, pred: str, needed: str, batch_keys: Sequence[str],
                      out: str = "target") -> DataFrame:
    """Scored output with the reference's sentinels.

    Per batch: not needed -> 0; any missing/NaN prediction -> every row 44,444,444;
    else any infinite one -> 99,999,999; else the prediction clipped at 0.
    Batch flags come from a grouped aggregate, one small row per batch, broadcast up to ``MAX_FLAGS``
    batches, so a batch's rows are not gathered in one task.
    """
    p = F.col(pred)
    flags = df.groupBy(*batch_keys).agg(
        F.bool_or(F.col(needed)).alias("_needed"),
        F.bool_or(p.isNull() | F.isnan(p)).alias("_nan"),
        F.bool_or(F.abs(p) == F.lit(float("inf"))).alias("_inf"),
    )
    j = df.join(bounded_broadcast(flags, MAX_FLAGS), on=list(batch_keys), how="inner")
    value = (F.when(~F.col("_needed"), F.lit(0.0)).when(F.col("_nan"), F.lit(44_444_444.0))
             .when(F.col("_inf"), F.lit(99_999_999.0)).when(p < 0, F.lit(0.0)).otherwise(p))
    return j.withColumn(out, value).drop("_needed", "_nan", "_inf")


def read_feed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The files of a feed folder as a stream; all that wait make one micro-batch unless ``files_per_trigger`` says fewer."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def append_log(batch_df: DataFrame, batch_id: int, log_dir: str) -> None:
    """Idempotent append: a batch owns the partition ``batch_id`` and overwrites it on replay."""
    (batch_df.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id").parquet(log_dir))


def run_to_log(stream: DataFrame, log_dir: str, checkpoint: str,
               transform: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Drain a feed with ``availableNow``; each micro-batch (optionally transformed) goes to the log.

    ``log_dir`` and ``checkpoint`` belong together: batch ids go on from the checkpoint.
    """

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        out = transform(batch_df, batch_id) if transform else batch_df
        append_log(out, batch_id, log_dir)

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def run_to_files(stream: DataFrame, out_dir: str, checkpoint: str) -> None:
    """Drain a stateful stream with ``availableNow`` into Parquet files (append mode)."""
    q = (stream.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


def latest_view(spark: SparkSession, log_dir: str, keys: Sequence[str], block: str = BLOCK) -> DataFrame:
    """Current table state: one row per key, the latest data block winning (I1 reader side)."""
    return latest_per_key(spark.read.parquet(log_dir).drop("batch_id"), keys, block)


# --- Table state: a log of batches, folded into snapshots ---------------------------------------
def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, pattern: str, name: Callable) -> list[int]:
    """The numbers of ``key=number`` folders that a glob pattern finds."""
    path, fs = _fs(spark, pattern)
    return sorted(int(name(s.getPath()).getName().split("=")[1]) for s in fs.globStatus(path) or [])


def snapshots(spark: SparkSession, state_dir: str) -> list[int]:
    """Complete snapshots by the last batch that each holds; one without its success mark does not count."""
    return _numbers(spark, f"{state_dir}/snapshots/upto=*/_SUCCESS", lambda p: p.getParent())


def append_state(batch_df: DataFrame, batch_id: int, state_dir: str, step: int = 0) -> None:
    """Append one step of a batch to a state's log; a replay overwrites it."""
    (batch_df.withColumns({"batch_id": F.lit(batch_id).cast("long"), "step": F.lit(step).cast("long")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "step").parquet(f"{state_dir}/log"))


def _state_rows(spark: SparkSession, state_dir: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The latest snapshot's rows and those of the batches after it (up to ``upto``), with their data blocks."""
    done = [n for n in snapshots(spark, state_dir) if upto is None or n <= upto]
    since = done[-1] if done else -1
    path, fs = _fs(spark, f"{state_dir}/log")
    rows = spark.createDataFrame([], schema)
    if fs.exists(path):
        logged = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()), T.StructField("step", T.LongType())])
        log = spark.read.schema(logged).option("basePath", f"{state_dir}/log").parquet(f"{state_dir}/log").filter(F.col("batch_id") > since)
        rows = log.filter(F.col("batch_id") <= upto).drop("batch_id", "step") if upto is not None else log.drop("batch_id", "step")
    if done:
        rows = rows.unionByName(spark.read.schema(schema).parquet(f"{state_dir}/snapshots/upto={since}"))
    return rows


def state_view(spark: SparkSession, state_dir: str, schema: T.StructType, keys: Sequence[str], block: str = BLOCK,
               as_of: int | None = None) -> DataFrame:
    """Current table state from snapshot and later log: one row per key, the latest data block winning.

    ``as_of`` leaves out later blocks than that, for instance those that a batch being replayed has already logged.
    """
    rows = _state_rows(spark, state_dir, schema)
    return latest_per_key(rows if as_of is None else rows.filter(F.col(block) <= as_of), keys, block)


def compact(spark: SparkSession, state_dir: str, schema: T.StructType, keys: Sequence[str], upto: int, block: str = BLOCK) -> None:
    """Fold the state up to batch ``upto`` into a snapshot: merged by data block, the winning block kept beside its row.

    The snapshot's success mark is the pointer: until it is there readers use the snapshot before, with the log after that.
    Batches and snapshots that neither the new nor the previous snapshot needs are removed afterwards.
    """
    rows = _state_rows(spark, state_dir, schema, upto).withColumn("_block", F.col(block))
    latest_per_key(rows.withColumnRenamed(block, "_order"), keys, "_order").withColumnRenamed("_block", block).select(
        *schema.fieldNames()).write.mode("overwrite").parquet(f"{state_dir}/snapshots/upto={upto}")
    done = snapshots(spark, state_dir)
    if len(done) < 2:
        return
    for n in done[:-2]:
        remove_dir(spark, f"{state_dir}/snapshots/upto={n}")
    for n in _numbers(spark, f"{state_dir}/log/batch_id=*", lambda p: p):
        if n <= done[-2]:
            remove_dir(spark, f"{state_dir}/log/batch_id={n}")


def stream_state(spark: SparkSession, folder: str, schema: T.StructType, state_dir: str, checkpoint: str, keys: Sequence[str],
                 compact_every: int = 16, files_per_trigger: int | None = None, before: Callable[[int], None] | None = None) -> DataFrame:
    """Incremental upsert into a compacted state (I1); ``before`` is called with each batch's number."""

    def sink(batch_df: DataFrame, batch_id: int) -> None:
        if before:
            before(batch_id)
        append_state(batch_df, batch_id, state_dir)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, state_dir, schema, keys, batch_id)

    q = (read_feed(spark, folder, schema, files_per_trigger).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return state_view(spark, state_dir, schema, keys)


def stream_upsert(spark: SparkSession, folder: str, schema: T.StructType, log_dir: str, checkpoint: str,
                  keys: Sequence[str], files_per_trigger: int | None = None) -> DataFrame:
    """Incremental upsert of a table arriving as files (I1); ``schema`` includes the data block's number."""
    run_to_log(read_feed(spark, folder, schema, files_per_trigger), log_dir, checkpoint)
    return latest_view(spark, log_dir, keys)


def refresh_tables(spark: SparkSession, feed_root: str, state_root: str, schemas: Mapping[str, T.StructType],
                   keys: Mapping[str, Sequence[str]] = KEYS, files_per_trigger: int | None = None) -> dict[str, DataFrame]:
    """Upsert every table of ``keys`` from ``feed_root/<table>`` into ``state_root/<table>`` (I1, all tables of a step)."""
    return {name: stream_state(spark, f"{feed_root}/{name}", schemas[name], f"{state_root}/{name}",
                               f"{state_root}/{name}/checkpoint", cols, files_per_trigger=files_per_trigger)
            for name, cols in keys.items()}


def read_steps(spark: SparkSession, feed_root: str, schemas: Mapping[str, T.StructType], files_per_trigger: int | None = None,
               block: str = BLOCK) -> DataFrame:
    """The feeds ``feed_root/<name>`` as one stream: feed (its name), the data block, and a struct column for each feed."""
    out = None
    for name, schema in schemas.items():
        rows = read_feed(spark, f"{feed_root}/{name}", schema, files_per_trigger)
        tagged = rows.select(F.lit(name).alias("feed"), F.col(block), F.struct(*[F.col(f"`{c}`") for c in schema.fieldNames()]).alias(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def stream_features(spark: SparkSession, folder: str, schema: T.StructType, log_dir: str, checkpoint: str,
                    build: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = None) -> DataFrame:
    """Feature refresh per arriving batch of items (I2): ``build`` is the batch feature function."""
    run_to_log(read_feed(spark, folder, schema, files_per_trigger), log_dir, checkpoint, lambda b, _i: build(b))
    return spark.read.parquet(log_dir).drop("batch_id")


def dedupe(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "16 days") -> DataFrame:
    """Duplicates dropped within a watermark (I4); state is bounded by ``delay``."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def sliding_sum(stream: DataFrame, keys: Sequence[str], ts: str, col: str, period: str, every: str, out: str,
                delay: str = "1 day") -> DataFrame:
    """Live sliding-window sum (I5): in append mode a window is emitted once the watermark has passed its end."""
    agg = stream.withWatermark(ts, delay).groupBy(*keys, F.window(ts, period, every).alias("_w")).agg(F.sum(col).alias(out))
    return agg.select(*keys, F.col("_w.end").alias(ts), out)
