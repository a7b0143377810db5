"""Helpers shared by the text operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

WORD_GAP = r"[\x20\x09-\x0D]+"
PIECE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}
_ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def text_key() -> list[Column]:
    """Two 64-bit hashes of a text; with doc_id they name a row (identical rows share a name)."""
    t = text_or_empty()
    return [F.xxhash64(t).alias("_k1"), F.xxhash64(F.lit("second"), F.length(t), t).alias("_k2")]


def row_name() -> list[Column]:
    """Null-free columns that name a row: doc_id, whether it is null, and the text's hashes."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), *text_key()]


ROW_NAME = ["_id", "_none", "_k1", "_k2"]


def packed(docs: DataFrame) -> Column:
    """All columns in one struct, so that theirs and an operator's names never meet."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("_row")


def unpacked(docs: DataFrame, **changed: Column) -> list[Column]:
    """The columns of ``docs`` from the struct, some replaced."""
    return [changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the root and of its inverse, at least ``n`` of them."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _ROOT), ("down", pow(_ROOT, -1, 1 << 64))):
            _POWERS[name] = np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE_BYTES + 4096), base, np.uint64)]).cumprod(dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if buffers[2] is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words of a string column, and the number of words before each row.

    Works through the column's bytes in pieces cut at word gaps, so memory beyond the
    hashes themselves does not depend on the length of a text.
    """
    data, offsets = string_buffers(column)
    n = len(data)
    hashes, ends_at = [], []
    row_start = np.unique(offsets[:-1])
    row_start = row_start[row_start < n]
    at = 0
    while at < n:
        to = min(n, at + PIECE_BYTES)
        while to < n and not _SPACE[data[to]]:  # on to the end of this word
            gap = np.flatnonzero(_SPACE[data[to : to + 4096]])
            to = to + int(gap[0]) if len(gap) else min(n, to + 4096)
        piece = data[at:to]
        solid = ~_SPACE[piece]
        before = np.empty_like(solid)
        before[0], before[1:] = False, solid[:-1]
        inside = row_start[np.searchsorted(row_start, at) : np.searchsorted(row_start, to)] - at
        before[inside] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1], after[:-1] = False, solid[1:]
        after[inside[inside > 0] - 1] = False
        ends = np.flatnonzero(solid & ~after) + 1
        if len(starts):
            up, down = _powers(len(piece) + 1)
            values = (_LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(piece)], dtype=np.uint64)])
            hashes.append(mix64((total[ends] - total[starts]) * down[starts]))
            ends_at.append(starts + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    positions = np.concatenate(ends_at)
    return np.concatenate(hashes), np.searchsorted(positions, offsets)
