"""Importance resampling towards the distribution of target texts.

An untrained Regex Split of the tokenizers library cuts the ASCII-lowered text into words with their offsets.  Windows over the offset
pairs (first word's start, last word's end) give the n-grams; each goes to the bucket crc32(n-gram) mod ``BUCKETS``.  Buckets are counted over all
documents and over all target texts, and a bucket's gain is floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))).  A
document's weight is the floored mean of the gains of its n-grams; a Gumbel variate from a hash of its id is added, and the
highest ``percent`` of the documents with ``MIN_WORDS`` words are drawn.

A document's buckets are written once in the shared folder, so texts are cut once; the tables of buckets have ``BUCKETS`` rows at most.
Ranks come from a range-partitioned order of narrow rows.

Null and empty texts have no n-gram, weight 0 and are not drawn; texts of any length are cut whole, in pieces ending between words; a null
doc_id hashes as an empty id and comes last among ties; rows equal in score and id are ordered by their number of
n-grams; an empty table gives an empty result, an empty target gains by the documents' counts alone.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import global_row_index
from ..session import ensure_checkpoint_dir, scratch_dir
from .common import text_or_empty

BUCKETS = 10_000
MIN_WORDS = 20
SEED = 2024
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = 1 << 20
MEMO = 200_000  # n-grams whose buckets a task remembers


class Features:
    """Buckets of the n-grams of texts; remembers those of a task's n-grams up to ``MEMO``."""

    def __init__(self, shortest: int, longest: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.sizes, self.buckets = range(shortest, longest + 1), buckets
        self.gap = regex.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
        self.gaps = regex.compile(self.gap.pattern + "+")
        self.memo: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[tuple[str, list[tuple[str, tuple[int, int]]], int]]:
        """Pieces of the lowered text, their (word, offsets) pairs, and how many of these the piece before had too.

        A piece ends before a character that is in no word and begins with the last words of the one before, so that windows cross.
        """
        text = text.encode().lower().decode()  # bytes: A-Z alone
        at, again, keep = 0, 0, self.sizes[-1] - 1
        while True:
            found = self.gap.search(text, at + PIECE) if len(text) - at > PIECE else None
            piece = text[at : found.start()] if found else text[at:]
            pairs = self.split(piece)
            yield piece, pairs, again
            if not found:
                return
            again = min(keep, len(pairs))
            at += pairs[-again][1][0] if again else len(piece)

    def bucket(self, gram: str) -> int:
        found = self.memo.get(gram)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[gram] = zlib.crc32(gram.encode()) % self.buckets
        return found

    def of(self, text: str) -> tuple[int, list[int]]:
        """Number of words and the buckets of all n-grams."""
        total, out = 0, []
        for piece, pairs, again in self.pieces(text):
            total += len(pairs) - again
            for size in self.sizes:
                first = max(0, again - size + 1)  # windows that end in a new word
                if size == 1:
                    out.extend([self.bucket(word) for word, _ in pairs[first:]])
                else:
                    ends = zip(pairs[first:], pairs[first + size - 1 :])
                    out.extend([self.bucket(self.gaps.sub(" ", piece[a:b])) for (_, (a, _)), (_, (_, b)) in ends])
        return total, out


def featured(docs: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the buckets of all n-grams of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shortest, longest, buckets)
        for batch in batches:
            at, n_words, ends, flat = 0, [], [0], []
            for i in range(batch.num_rows):
                n, found = features.of(batch.column(1)[i].as_py() or "")
                n_words.append(n)
                flat.append(np.array(found, dtype=np.int32))
                ends.append(ends[-1] + len(found))
                if ends[-1] >= PIECE // 4 or i == batch.num_rows - 1:
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), pa.array(n_words, pa.int64()), lists], ["doc_id", "n_words", "buckets"])
                    at, n_words, ends, flat = i + 1, [], [0], []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket: counted in every task, then summed, ``buckets`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log ratio of the two smoothed models, floored, for each bucket."""
    n = float(len(corpus))
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain; none: 0)."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < batch.num_rows:  # rows of about ``PIECE`` // 4 n-grams, one row at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE // 4, side="right")) - 1)
                inside = ends[at : to + 1]
                upto = np.concatenate([[0], np.cumsum(shared.value[lists.values.to_numpy()[inside[0] : inside[-1]]])])
                n = np.diff(inside)
                total = np.diff(upto[inside - inside[0]])
                rows = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])
                at = to

    return rows.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int = SEED) -> Column:
    """floor(1000 x a Gumbel variate) of a document's id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(docs: DataFrame, target: DataFrame, percent: int = 10, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) of every row of ``docs``; ``target`` has a column text."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = scratch_dir("features-")
    featured(docs, shortest, longest, buckets).write.parquet(folder)
    rows = spark.read.parquet(folder)
    wanted = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), shortest, longest, buckets)
    scored = weighed(rows, gains(histogram(rows, buckets), histogram(wanted, buckets))).withColumn("score", F.col("weight") + noise(seed))
    ordered = scored.select("*", (F.col("n_words") < min_words).alias("_short"), (-F.col("score")).alias("_low"), F.col("doc_id").isNull().alias("_none"))
    ordered = global_row_index(ordered, ["_short", "_low", "_none", "doc_id", "n_features"], "_at")
    eligible = rows.filter(F.col("n_words") >= min_words).count()
    rank = F.when(~F.col("_short") & (F.col("_at") < percent * eligible // 100), F.col("_at") + 1)
    return ordered.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))
