"""SimHash near-duplicates through Golay-code keys.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits, each read as a
word of the binary Golay code of length 23 (missing high bits are zero).  The code is
perfect: every 23-bit word is within three bits of exactly one of its 4,096 codewords.  The keys of a
segment are the indices of all codewords within four bits of it: one, or six when the nearest is three
bits away.  If two segments differ in at most one bit, the nearest codeword of one is
within four bits of the other, so one side needs its nearest index alone and the other side
its whole key set.  Three errors over three segments leave two segments with at most one
error each, so two fingerprints within three bits meet on the key pair of two segments.
Matches are verified by the bits themselves.

Equal fingerprints are one node, so exact copies never meet as pairs.  Chains of one-bit
differences are joined first, by looking each one-bit neighbour up; the key join then leaves out pairs
that are already in one component, so a dense group costs neither pairs nor links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_NAME, packed, reliable, row_name, text_key, text_or_empty, unpacked

SEED = 42
KEYED_ROWS = 20_000  # nodes whose keys one task makes
MANY_EDGES = 100_000  # edges beyond which no star step may broadcast
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (shift, width)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """64 majority bits of the hashes of the word shingles (repeats count); no word: zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    stops = (ends - 1)[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    n = len(starts)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], stops[at : at + 65536])], dtype="<u8")
        seen = np.bincount((h.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048)
        counts += (seen.reshape(8, 256) @ _BITS).ravel()
    bits = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64), type=pa.int64())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, two text hashes and the fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            found = _signed([fingerprint_of(texts[i].as_py(), shingle) for i in range(len(texts))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), found], ["doc_id", "_k1", "_k2", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long")


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Error pattern (at most three bits) of each of the 2,048 syndromes; the weight-7 codewords."""
    generator = 0b101011100011

    def syndrome(word: np.ndarray) -> np.ndarray:
        word = word.copy()
        for bit in range(22, 10, -1):
            word = np.where((word >> bit) & 1, word ^ (generator << (bit - 11)), word)
        return word

    single = 1 << np.arange(23, dtype=np.int64)
    two = np.array([a | b for i, a in enumerate(single) for b in single[:i]])
    three = np.array([a | b | c for i, a in enumerate(single) for j, b in enumerate(single[:i]) for c in single[:j]])
    patterns = np.concatenate([np.zeros(1, np.int64), single, two, three])
    table = np.zeros(2048, np.int64)
    table[syndrome(patterns)] = patterns
    high = np.arange(4096, dtype=np.int64) << 11
    codewords = high ^ syndrome(high)
    weight = np.array([int(c).bit_count() for c in codewords])
    return table, codewords[weight == 7]


_TABLE, _SEVEN = _golay()
_NEAR = {int(p): [int(c) for c in _SEVEN if int(c) & int(p) == int(p)] for p in _TABLE if int(p).bit_count() == 3}


def _syndrome(word: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        word = np.where((word >> bit) & 1, word ^ (0b101011100011 << (bit - 11)), word)
    return word


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest codeword, and a matrix of six indices whose codewords are within four bits (-1: none)."""
    errors = _TABLE[_syndrome(words)]
    nearest = words ^ errors
    keys = np.full((len(words), 6), -1, dtype=np.int64)
    keys[:, 0] = nearest >> 11
    lookup = np.zeros((2048, 5), dtype=np.int64)
    is_three = np.zeros(2048, dtype=bool)
    for s, p in enumerate(_TABLE):
        if int(p) in _NEAR:
            lookup[s], is_three[s] = _NEAR[int(p)], True
    s = _syndrome(words)
    far = is_three[s]
    keys[far, 1:] = (nearest[far, None] ^ lookup[s[far]]) >> 11
    return keys[:, 0].copy(), keys


def _segment_keys(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    u = fps.view(np.uint64)
    return [golay_keys(((u >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)) for shift, width in SEGMENTS]


_PAIRS = ((0, 1), (0, 2), (1, 2))


def _keyed(nodes: DataFrame, whole: bool) -> DataFrame:
    """key, fp, comp: one key per segment pair, or (whole) all pairs of the two key sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                fps = part.column(0).to_numpy(zero_copy_only=False)
                comp = part.column(1).to_numpy(zero_copy_only=False)
                segments = _segment_keys(fps)
                keys, rows = [], []
                for p, (a, b) in enumerate(_PAIRS):
                    if whole:
                        left, right = segments[a][1][:, :, None], segments[b][1][:, None, :]
                        both = ((left << 12) | right) | (p << 24)
                        row, i, j = np.nonzero((left >= 0) & (right >= 0))
                        keys.append(both[row, i, j])
                        rows.append(row)
                    else:
                        keys.append(((segments[a][0] << 12) | segments[b][0]) | (p << 24))
                        rows.append(np.arange(len(fps)))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int32)), pa.array(fps[row]), pa.array(comp[row])], ["key", "fp", "comp"])

    return nodes.select("fp", "comp").mapInArrow(run, "key int, fp long, comp long")


def _star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
    """One star step on edges (u, v) with u > v.

    Spark's size estimate leaves out the explode that edges come from, so the joins of ``many`` edges are told not to broadcast.
    """
    if large:  # each larger neighbour, and the node itself, moves to the smallest neighbour
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(least.hint("merge") if many else least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least.hint("merge") if many else least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
    return moved.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that occurs in ``edges`` (u, v) and is not its component's smallest.

    Alternating star contraction; rounds grow with the logarithm of the longest path.
    """
    edges = reliable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now
        many = now[0] > MANY_EDGES
        edges = reliable(_star(_star(edges, True, many), False, many))


def link(prints: DataFrame, max_distance: int = 3) -> DataFrame:
    """(fp, comp) of every distinct fingerprint: comp is the smallest fingerprint reachable over links of at most
    ``max_distance`` (up to three) differing bits."""
    if not 0 <= max_distance <= 3:
        raise ValueError("the segment keys find up to three differing bits")
    nodes = reliable(prints.select("fp").distinct())
    if max_distance == 0:
        return nodes.select("fp", F.col("fp").alias("comp"))
    ones = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    near = nodes.select(F.col("fp").alias("u"), F.explode(F.expr(f"transform(array({', '.join(f'{x}L' if x > -(1 << 63) else f'shiftleft(1L, 63)' for x in ones)}), b -> fp ^ b)")).alias("v")).filter("v < u")
    first = components(near.join(nodes.select(F.col("fp").alias("v")), "v", "left_semi"))
    nodes = nodes.join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("comp", "fp").alias("comp"))
    if max_distance > 1:
        nodes = reliable(nodes)
        nodes = nodes.repartition(1 + nodes.count() // KEYED_ROWS)  # a node becomes about 85 key rows
        mine = _keyed(nodes, False)
        other = _keyed(nodes, True).select("key", F.col("fp").alias("fp2"), F.col("comp").alias("comp2"))
        # Spark sizes what mapInArrow returns by the nodes that go in, so it would broadcast key rows of many times its threshold.
        more = (
            mine.join(other.hint("merge"), "key")
            .filter((F.col("comp") != F.col("comp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_distance))
            .select(F.col("comp").alias("u"), F.col("comp2").alias("v"))
        )
        second = components(more).select("node", F.col("comp").alias("joined"))
        nodes = nodes.join(second, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("joined", "comp").alias("comp"))
    return nodes


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """doc_id, text hashes, fingerprint (long) and component_id of every row.

    A null text is empty; texts without a word have fingerprint zero and link like any other; repeated
    rows each come back; null doc_ids take part and a component's id is its smallest non-null doc_id (null if there is none).
    """
    prints = reliable(fingerprints(docs, shingle))
    linked = link(prints, max_distance)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = reliable(linked.join(least, "fp"))
    ids = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = linked.join(ids, "comp").select("fp", "comp", "component_id")
    return prints.join(ids, "fp")


def deduplicate(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (nulls last), then text hash.

    Other columns pass unchanged; of identical rows one stays.
    """
    found = near_duplicates(docs, shingle, max_distance)
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_k1"), F.col("_k2"))
    kept = found.groupBy("comp").agg(F.min(name).alias("m")).select("m.*")
    id_, none = F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")
    kept = reliable(kept.select(id_, none, "_k1", "_k2"))
    many = reliable(found.groupBy(id_, none, "_k1", "_k2").count().filter("count > 1").drop("count"))
    rows = docs.select(packed(docs), *row_name()).join(kept, ROW_NAME, "left_semi")
    single = rows.join(many, ROW_NAME, "left_anti")
    repeated = rows.join(many, ROW_NAME, "left_semi").dropDuplicates(ROW_NAME)
    return single.unionByName(repeated).select(*unpacked(docs))
