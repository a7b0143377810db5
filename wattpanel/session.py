"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows and bytes above which a dimension is no longer broadcast (joined by shuffle instead).
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_BROADCAST_BYTES = 256 << 20


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "wattpanel") -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitter's session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Lag tables and row statistics widen their input many times, so partitions that look tiny are not merged.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Settings the results depend on; safe to call on an existing session.

    Broadcast thresholds stay the caller's: small dimensions are broadcast by Spark's own size
    estimate or by AQE from measured sizes, and explicit hints are row-bounded (``bounded_broadcast``).
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Joins take sides that are dealt alike by some of their keys as they lie: a chain of lag joins shuffles its left side once.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only a local session that names none gets a scratch folder; on a cluster its absence is an error,
    since executors do not share a machine's temporary folder.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="wattpanel-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows of together at most ``max_bytes``.

    The check reads at most ``max_rows + 1`` rows and adds up the lengths of strings and the sizes of lists and maps to the
    width of the other columns.  Beyond the bound the frame is
    returned unhinted, so the join falls back to a shuffle join (and AQE may still
    pick a broadcast at run time from real sizes).
    """
    width, parts = 8, []
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.octet_length(c))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            parts.append(F.greatest(F.size(c), F.lit(0)) * _width(f.dataType))
        else:
            width += _width(f.dataType)
    sizes = [F.coalesce(F.sum(p.cast("long")), F.lit(0)) for p in parts]
    row = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), *[s.alias(f"_s{i}") for i, s in enumerate(sizes)]).first()
    whole = row["n"] * width + sum(row[1:])
    return F.broadcast(df) if row["n"] <= max_rows and whole <= max_bytes else df


def _width(kind: T.DataType) -> int:
    """Bytes of a value; strings inside nested values count as 64."""
    if isinstance(kind, T.StructType):
        return 8 + sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _width(kind.elementType)
    if isinstance(kind, T.MapType):
        return _width(kind.keyType) + _width(kind.valueType)
    return 64 if isinstance(kind, (T.StringType, T.BinaryType)) else 8


def scratch_dir(prefix: str = "wattpanel-") -> str:
    """The path of a new folder under the checkpoint root (shared on a cluster); whoever writes to it makes it."""
    root = ensure_checkpoint_dir(SparkSession.active())
    return f"{root.rstrip('/')}/{prefix}{uuid.uuid4().hex}"


def remove_dir(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the library's own, through the file system that its path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
