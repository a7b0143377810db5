"""Language identification as mixture inference.

Each language has a model of hashed byte n-grams (``WIDTH`` bytes of the lower-cased text, letters only, words spaced), learned from
labelled documents.  A document's n-grams are taken as draws from a mixture of languages; expectation-maximisation
estimates its proportions, and the language set is the one whose log-likelihood minus ``PENALTY`` x log(n-grams) / 2 for each language
is largest, among the best single language and the leading languages of the full mixture.  The prediction is
the set's largest share.

Training takes at most about ``TRAIN_DOCS`` documents of a language (a hash sample; the bound is a parameter).  Text that is null or
has no letter is ``und`` with score 0; so is everything if there is nothing to learn from.  Repeated rows get equal results;
a null doc_id is neither held out nor learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import string_buffers, text_or_empty

WIDTH = 4
BUCKETS = 1 << 16
TRAIN_DOCS = 4_000
PENALTY = 4.0
SETTLED = 1e-4  # EM ends when no share of a row moves further in a round
SHRINK = 2_000.0  # pooled n-grams added to each language's counts
SLICE_BYTES = 1 << 20

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[:128] = 32
_TABLE[97:123] = np.arange(97, 123)


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the distinct n-grams of each row (sorted by row, then bucket)."""
    data, offsets = string_buffers(pc.utf8_lower(texts))
    n = len(data)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none
    b = _TABLE[data].astype(np.uint64)
    h = np.zeros(n - WIDTH + 1, np.uint64)
    for i in range(WIDTH):
        h = h * np.uint64(257) + b[i : n - WIDTH + 1 + i]
    space = b == 32
    use = ~(space[:-1] & space[1:])[: n - WIDTH + 1]  # no grams that begin in a run of spaces
    for i in range(1, WIDTH - 1):
        use &= ~(space[i : n - WIDTH + 1 + i] & space[i + 1 : n - WIDTH + 2 + i])
    for i in range(1, WIDTH):  # nor across rows
        at = offsets[1:-1] - i
        use[at[(at >= 0) & (at < len(use))]] = False
    at = np.flatnonzero(use)
    bucket = ((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64) % BUCKETS
    row = np.searchsorted(offsets, at, side="right") - 1
    keys, counts = np.unique(row * BUCKETS + bucket, return_counts=True)
    return keys // BUCKETS, keys % BUCKETS, counts


def _has_letter(text: str) -> bool:
    """Whether a text has a letter; the pattern also finds other number characters, so its hit is looked at."""
    hit = _LETTER.search(text)
    return hit is not None and (hit[0].isalpha() or any(map(str.isalpha, text[hit.end() :])))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def fold(name: str = "doc_id") -> Column:
    """The split that is given: documents of remainder 2 are held out."""
    return F.crc32(F.col(name).cast("string")) % 4


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, log-probabilities [bucket, language], log prior) from rows with doc_id, lang and text."""
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.element_at(F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, train_docs / sizes[k])))]), F.col("lang"))
    place = F.element_at(F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))]), F.col("lang"))
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit("train"), "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    sample = labelled.filter(uniform < share).select(place.alias("language"), text_or_empty().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for whole in batches:
            for batch in _slices(whole, 1):
                row, bucket, counts = _grams(batch.column(1))
                np.add.at(total, (batch.column(0).to_numpy(zero_copy_only=False)[row], bucket), counts)
        language, bucket = np.nonzero(total)
        for i in range(0, len(bucket), 1 << 16):
            a, b = language[i : i + 65536], bucket[i : i + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["language", "bucket", "n"])

    seen = sample.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most languages x buckets rows
    counts = np.zeros((BUCKETS, len(languages)))
    counts[seen.column("bucket").to_numpy(), seen.column("language").to_numpy()] = seen.column("n").to_numpy()
    pooled = (counts.sum(1) + 1) / (counts.sum() + BUCKETS)
    model = (counts + SHRINK * pooled[:, None]) / (counts.sum(0) + SHRINK)
    prior = np.array([sizes[k] for k in languages], float)
    return languages, np.log(model).astype(np.float32), np.log(prior / prior.sum())


def _em(p: np.ndarray, c: np.ndarray, row: np.ndarray, starts: np.ndarray, shares: np.ndarray, settled: float = SETTLED) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihood relative to p's scale) of each row once EM has settled (its likelihood never falls, so it does)."""
    totals = np.add.reduceat(c, starts)
    moved = settled
    while moved >= settled:
        joint = p * shares[row]
        mix = joint.sum(1)
        after = np.add.reduceat(joint * (c / mix)[:, None], starts, axis=0) / totals[:, None]
        moved = np.abs(after - shares).max()
        shares = after
    mix = (p * shares[row]).sum(1)
    return shares, np.add.reduceat(c * np.log(np.maximum(mix, 1e-300)), starts)


def infer(texts: pa.Array, model: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, shares) of each row; index -1: no n-gram."""
    n, k = len(texts), model.shape[1]
    best = np.full(n, -1)
    score = np.zeros(n)
    shares = np.zeros((n, k))
    row, bucket, counts = _grams(texts)
    if not len(row):
        return best, score, shares
    rows, starts, local = np.unique(row, return_index=True, return_inverse=True)
    logs = model[bucket]
    c = counts.astype(float)
    alone = np.add.reduceat(logs * c[:, None], starts, axis=0)
    weighed = alone + prior
    first = weighed.argmax(1)
    odds = np.exp(weighed - weighed.max(1, keepdims=True))
    score[rows] = (odds.max(1) / odds.sum(1)).clip(0, 1)
    best[rows] = first
    shares[rows, first] = 1.0
    if k == 1:
        return best, score, shares
    # the slope of the likelihood at one language alone bounds what a mixture can gain (it is concave)
    totals = np.add.reduceat(c, starts)
    ratio = np.exp(np.minimum(logs - logs[np.arange(len(local)), first[local]][:, None], 50))
    slope = np.add.reduceat(ratio * c[:, None], starts, axis=0).max(1) - totals
    price = PENALTY * np.log(np.maximum(totals, 2)) / 2
    open_rows = np.flatnonzero(slope > price)
    if not len(open_rows):
        return best, score, shares
    keep = np.isin(local, open_rows)
    sub = np.searchsorted(open_rows, local[keep])
    sub_starts = np.flatnonzero(np.concatenate([[True], sub[1:] != sub[:-1]]))
    logs, c = logs[keep], c[keep]
    top = logs.max(1)
    p = np.exp(logs - top[:, None])
    shift = np.add.reduceat(c * top, sub_starts)
    full, _ = _em(p, c, sub, sub_starts, np.full((len(open_rows), k), 1.0 / k))
    order = np.argsort(-full, axis=1, kind="stable")
    value = alone[open_rows, first[open_rows]] - price[open_rows]
    chosen = shares[rows[open_rows]]
    grams = np.add.reduceat(c, sub_starts)
    for size in range(2, k + 1):  # a language of less than one n-gram gains nothing; all others are left to the penalty
        able = np.flatnonzero(np.take_along_axis(full, order[:, size - 1 : size], 1)[:, 0] * grams >= 1)
        if not len(able):
            break
        mask = np.zeros((len(able), k))
        np.put_along_axis(mask, order[able, :size], 1.0, 1)
        mine = np.isin(sub, able)
        again = np.searchsorted(able, sub[mine])
        again_starts = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1]]))
        start = full[able] * mask
        got, likelihood = _em(p[mine], c[mine], again, again_starts, start / start.sum(1, keepdims=True))
        new = likelihood + shift[able] - size * price[open_rows[able]]
        better = new > value[able]
        value[able[better]] = new[better]
        chosen[able[better]] = got[better]
    mixed = (chosen > 0).sum(1) > 1
    at = rows[open_rows[mixed]]
    shares[at] = chosen[mixed]
    best[at] = chosen[mixed].argmax(1)
    score[at] = chosen[mixed].max(1).clip(0, 1)
    return best, score, shares


def identify(docs: DataFrame, labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, lang_pred, score and languages (share of each language of the set, largest first) of every row of ``docs``."""
    learned = learn(labelled, train_docs)
    languages, model, prior = learned or ([], np.zeros((0, 0), np.float32), np.zeros(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                texts = batch.column(1)
                letters = np.array([_has_letter(t.as_py()) for t in texts], bool)
                n = batch.num_rows
                best, score, shares = infer(texts, shared.value, prior) if languages else (np.full(n, -1), np.zeros(n), np.zeros((n, 0)))
                if languages:  # letters, but too few for an n-gram
                    lone = letters & (best < 0)
                    best[lone] = int(prior.argmax())
                    score[lone] = float(np.exp(prior.max()))
                    shares[lone, best[lone]] = 1.0
                known = letters & (best >= 0)
                names = [languages[i] if ok else "und" for i, ok in zip(best.tolist(), known.tolist())]
                sets = [",".join(f"{languages[j]}:{s[j]:.3f}" for j in np.argsort(-s, kind="stable") if s[j] > 0) if ok else "" for s, ok in zip(shares, known.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(sets, pa.string())], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages string")
