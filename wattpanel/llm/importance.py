"""Quality classifier by importance resampling.

Word unigrams and bigrams are hashed into ``BUCKETS`` buckets.  The raw model counts the n-grams of all documents, the
target model those of labelled good documents (quality 1, not toxic; a bounded hash sample of ``TARGET_DOCS`` ids).  The log of the ratio
of the two models, summed over a block of ``BLOCK`` words, is the block's importance weight; a document is worth its
worst block, so a bad passage is not outweighed by the length of the rest.  Documents are drawn by Gumbel
top-k: a Gumbel variate (from a hash of the row, so reruns agree) is added to the log weight and the k largest stay.
k is the number of rows whose perturbed weight reaches that of the lowest ``1 - KEEP`` of held-out good documents, or the caller's.

Null or empty texts have weight 0 and compete like others; repeated rows share weight and noise; without labelled good documents every row stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_NAME, mix64, packed, reliable, row_name, string_buffers, text_key, text_or_empty, unpacked, word_hashes

BUCKETS = 1 << 20
BLOCK = 32
TARGET_DOCS = 20_000
KEEP = 0.99
SMOOTH = 8.0  # added to a bucket's target count and to the count that the raw model expects there
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _grams(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, bucket of each word with its predecessor in the row (first: -1), word counts before each row."""
    words, rows = word_hashes(column)
    single = (words % np.uint64(buckets)).astype(np.int64)
    pair = np.full(len(words), -1, dtype=np.int64)
    if len(words) > 1:
        pair[1:] = (mix64(words[:-1] * _PAIR + words[1:]) % np.uint64(buckets)).astype(np.int64)
    first = rows[:-1]
    pair[first[(first < len(words)) & (first < rows[1:])]] = -1
    return single, pair, rows


def _slices(batch: pa.RecordBatch, column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch of about ``most_bytes`` of text (one row at least)."""
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def good_ids(labels: DataFrame, most: int = TARGET_DOCS) -> DataFrame:
    """doc_id and trains (four fifths) of at most ``most`` labelled good documents, the first by a hash."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    order = F.xxhash64(F.lit("target"), "doc_id")
    return good.orderBy(order, "doc_id").limit(most).withColumn("trains", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) > 0)


def fit(docs: DataFrame, good: DataFrame, buckets: int = BUCKETS) -> np.ndarray | None:
    """log(target / raw) of each bucket; None if no document is in the target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.zeros(buckets, dtype=np.int64)
        target = np.zeros(buckets, dtype=np.int64)
        for whole in batches:
            for batch in _slices(whole, 0):
                single, pair, rows = _grams(batch.column(0), buckets)
                raw += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
                mine = np.repeat(np.array(batch.column(1).to_pylist(), dtype=bool), np.diff(rows))
                if mine.any():
                    chosen = pair[mine]
                    target += np.bincount(single[mine], minlength=buckets) + np.bincount(chosen[chosen >= 0], minlength=buckets)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            b = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(raw[b]), pa.array(target[b])], ["bucket", "raw", "target"])

    marks = good.filter("trains").select(F.col("doc_id").alias("_good"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty().alias("text"))
    texts = texts.join(F.broadcast(marks), texts["_id"] == marks["_good"], "left").select("text", F.col("_good").isNotNull().alias("is_target"))
    sums = texts.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    seen = sums.toArrow()  # at most one row for each bucket
    raw, target = np.zeros(buckets), np.zeros(buckets)
    at = seen.column("bucket").to_numpy()
    raw[at], target[at] = seen.column("raw").to_numpy(), seen.column("target").to_numpy()
    if not target.sum():
        return None
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTH) / (expected + SMOOTH)).astype(np.float32)


def weigh(texts: pa.Array, ratio: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The smallest block weight of each row."""
    single, pair, rows = _grams(texts, len(ratio))
    out = np.zeros(len(rows) - 1)
    if not len(single):
        return out
    each = ratio[single].astype(np.float64)
    has = pair >= 0
    each[has] += ratio[pair[has]]
    n = np.diff(rows)
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(single)) - rows[row]
    blocks = np.maximum(1, (n + block // 2) // block)
    which = np.minimum(inside // block, blocks[row] - 1)
    starts = np.flatnonzero((which != np.concatenate([[-1], which[:-1]])) | (inside == 0))
    sums = np.add.reduceat(each, starts)
    out[:] = np.inf
    np.minimum.at(out, row[starts], sums)
    out[n == 0] = 0.0
    return out


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), *parts), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, _k1, _k2, log_weight and key (log weight plus Gumbel noise) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # a value for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 3):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(weigh(batch.column(3), shared.value))], ["doc_id", "_k1", "_k2", "log_weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, _k1 long, _k2 long, log_weight double")
    noise = -F.log(-F.log(_uniform("doc_id", "_k1", "_k2")))
    return rows.withColumn("key", F.col("log_weight") + noise)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """``scored`` with kept: true for the ``k`` rows of the largest keys (of rows equal in key, id and hashes all or none).

    The k-th key is found by counting in bins twice, then by order inside one narrow bin.
    """
    cell = F.least(F.greatest(F.floor("key"), F.lit(-100_000)), F.lit(100_000)).cast("long")
    binned = scored.withColumn("c", cell).withColumn("f", F.least(F.greatest(F.floor((F.col("key") - F.col("c")) * 65536), F.lit(0)), F.lit(65535)).cast("long"))

    def last(rows: list) -> tuple[int | None, int]:
        """The bin in which the count from above reaches what is left, and what is left for it."""
        left = want
        for b, n in sorted(rows, reverse=True):
            if n >= left:
                return b, left
            left -= n
        return None, left

    want = k
    if k <= 0:
        return scored.withColumn("kept", F.lit(False))
    c, want = last([(r[0], r[1]) for r in binned.groupBy("c").count().collect()])
    if c is None:
        return scored.withColumn("kept", F.lit(True))
    f, want = last([(r[0], r[1]) for r in binned.filter(F.col("c") == c).groupBy("f").count().collect()])
    edge = binned.filter((F.col("c") == c) & (F.col("f") == f)).groupBy("key", "_k1", "_k2", F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none")).count()
    order = [F.col("key").desc(), "_k1", "_k2", "d", "none"]
    first = edge.orderBy(*order).limit(want)
    line = first.orderBy(F.col("key"), F.col("_k1").desc(), F.col("_k2").desc(), F.col("d").desc(), F.col("none").desc()).limit(1).collect()[0]
    place = F.struct((-F.col("key")).alias("a"), F.col("_k1"), F.col("_k2"), F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("none"))
    limit = F.struct(F.lit(-line["key"]).alias("a"), F.lit(line["_k1"]).alias("_k1"), F.lit(line["_k2"]).alias("_k2"), F.lit(line["d"]).alias("d"), F.lit(line["none"]).alias("none"))
    return scored.withColumn("kept", place <= limit)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: float = KEEP, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, _k1, _k2, log_weight, key and kept of every row."""
    good = reliable(good_ids(labels))
    ratio = fit(docs, good, buckets)
    if ratio is None:
        return score(docs, np.zeros(buckets, dtype=np.float32)).withColumn("kept", F.lit(True))
    scored = reliable(score(docs, ratio))
    if k is None:
        held = good.filter("not trains").select(F.col("doc_id").alias("_held"))
        line = scored.join(F.broadcast(held), scored["doc_id"] == held["_held"], "left_semi").agg(F.percentile("key", 1 - keep)).first()[0]
        k = scored.filter(F.col("key") >= F.lit(line)).count() if line is not None else scored.count()
    return top_k(scored, k)


def select(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that importance resampling keeps; columns unchanged."""
    found = resample(docs, labels, k, keep)
    kept = reliable(found.filter("kept").select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "_k1", "_k2").distinct())
    return docs.select(packed(docs), *row_name()).join(kept, ROW_NAME, "left_semi").select(*unpacked(docs))
