"""Divergence audit of the sources of each language.

Every language keeps the terms that occur in at least ``MIN_DOCS`` of its documents.  A group (language and source) gives each kept term the price
1 + floor(10^9 (count + 5) / (N + 5 V)), N being its occurrences of the V kept terms.  Part ``pair`` holds the summed price differences of
every two sources of a language, part ``term`` the terms that a source overuses most against its language.

Kept terms are dealt by hash to blocks of about ``BLOCK`` terms and numbered inside them, so a group is a set of sorted (term id, count)
arrays of bounded length, however many terms it has.  Sources are dealt to tiles of about ``TILE``; a pair task co-groups two
tiles' arrays of one block and merges each unordered pair: the shorter array gallops through the longer one, terms in both,
in one only and in neither are priced apart, and the sum counts for both directions.  Sums over blocks follow in Spark.  An array travels once
for each tile, not for each source, and all arithmetic is in integers.

Null text, lang and source are empty ones; a source without kept terms takes part with counts of zero; a language without kept terms has
pairs of value 0 and no terms; repeated rows count each; ties go by the item's UTF-8 bytes; an empty table gives an empty result.
Texts of any length are cut in pieces between terms.  Only lang, source and text are read, so further columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .common import reliable

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
TOP = 50
SMOOTH = 5
SCALE = 1_000_000_000
BLOCK = 8_192
TILE = 8
PIECE = 1 << 22  # characters of text that are counted together
_SAFE = (1 << 62) // SCALE


def _plain(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TERM).findall
        gap = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]")

        def cut(text: str) -> Iterator[list[str]]:
            at = 0
            while len(text) - at > PIECE and (found := gap.search(text, at + PIECE)):
                yield find(text, at, found.start())
                at = found.start()
            yield find(text, at)

        def counted(groups: list[tuple[str, str]], of: list[int], words: list[str], owners: list[int], lengths: list[int]) -> pa.RecordBatch:
            """Counts of the (group, term) pairs; of: group of each row, owners and lengths: row and number of each run of words."""
            coded = pa.array(words, pa.string()).dictionary_encode()
            width = max(len(coded.dictionary), 1)
            row = np.repeat(np.array(owners, dtype=np.int64), lengths)
            code = coded.indices.to_numpy().astype(np.int64)
            group = np.array(of, dtype=np.int64)
            pair, n = np.unique(group[row] * width + code, return_counts=True)
            by_row = np.unique(row * width + code)
            _, in_docs = np.unique(group[by_row // width] * width + by_row % width, return_counts=True)
            names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
            at = pa.array(pair // width)
            columns = [*[x.take(at) for x in names], coded.dictionary.take(pa.array(pair % width)), pa.array(n), pa.array(in_docs)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            groups: dict[tuple[str, str], int] = {}
            of: list[int] = []
            words: list[str] = []
            owners: list[int] = []
            lengths: list[int] = []
            size = 0
            langs, sources = (batch.column(i).to_pylist() for i in (0, 1))
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().encode().lower().decode()  # bytes: A-Z alone
                of.append(groups.setdefault((langs[i], sources[i]), len(groups)))
                for found in cut(text):
                    words += found
                    owners.append(len(of) - 1)
                    lengths.append(len(found))
                size += len(text)
                if size >= PIECE or i == batch.num_rows - 1:
                    yield counted(list(groups), of, words, owners, lengths)
                    groups, of, words, owners, lengths, size = {}, [], [], [], [], 0

    parts = _plain(docs, "lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def gallop(needles: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place in ``ids`` of the first one not below each needle; both ascend.

    Needles are placed in rounds of halved strides.  Each starts at the place of a needle already placed below it, doubles
    its step until it has passed, then bisects the last step: short ways for neighbours, all needles of a round at once.
    """
    m, n = len(needles), len(ids)
    place = np.zeros(m, dtype=np.int64)
    stride = 1 << max(m - 1, 0).bit_length()
    base = np.zeros(m, dtype=np.int64)
    while stride >= 1:
        at = np.arange(0 if stride >= m else stride, m, 2 * stride)
        low = base[at - stride] if stride < m else np.zeros(len(at), np.int64)
        step = np.ones(len(at), dtype=np.int64)
        while (on := (low + step <= n) & (ids[np.minimum(low + step - 1, n - 1)] < needles[at]) if n else np.zeros(len(at), bool)).any():
            low = np.where(on, low + step, low)
            step = np.where(on, 2 * step, step)
        high = np.minimum(low + step, n)
        while (on := low < high).any():
            mid = (low + high) // 2
            less = on & (ids[np.minimum(mid, n - 1)] < needles[at])
            low, high = np.where(less, mid + 1, low), np.where(on & ~less, mid, high)
        place[at] = base[at] = low
        stride //= 2
    return place


def prices(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """Exact prices; counts beyond what a long can hold scaled go through unbounded integers."""
    below = total + SMOOTH * kept
    if not below:
        return np.ones(len(counts), dtype=np.int64)
    if len(counts) and int(counts.max()) >= _SAFE:
        return np.array([1 + SCALE * (int(c) + SMOOTH) // below for c in counts], dtype=np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + SMOOTH) // below


def merged(a: tuple[np.ndarray, np.ndarray, int], b: tuple[np.ndarray, np.ndarray, int], terms: int) -> int:
    """Summed price differences of two sides over a block of ``terms`` terms; a side is (ids, their prices, price of an absent term)."""
    (ids_a, price_a, none_a), (ids_b, price_b, none_b) = sorted((a, b), key=lambda x: len(x[0]))
    if not len(ids_b):
        return terms * abs(none_a - none_b)
    at = gallop(ids_a, ids_b)
    both = (at < len(ids_b)) & (ids_b[np.minimum(at, len(ids_b) - 1)] == ids_a)
    met = at[both]
    alone = np.ones(len(ids_b), dtype=bool)
    alone[met] = False
    total = int(np.abs(price_a[both] - price_b[met]).sum())
    total += int(np.abs(price_a[~both] - none_b).sum()) + int(np.abs(price_b[alone] - none_a).sum())
    return total + (terms - len(ids_a) - len(ids_b) + len(met)) * abs(none_a - none_b)


def _price(count: Column, total: Column, kept: Column) -> Column:
    """The same as a column; decimals hold every product exactly."""
    top = ((count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")).alias("top")
    return F.lit(1) + F.call_function("div", top, (total + SMOOTH * kept).cast("decimal(19,0)")).cast("long")


def _pair_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of every two sources, one of each side (of one tile: each unordered pair once), the block's summed differences."""

    def sides(table: pa.Table) -> list[tuple[str, tuple[np.ndarray, np.ndarray, int]]]:
        out = []
        for row in range(table.num_rows):
            get = lambda name: table.column(name)[row]
            ids, counts = (np.array(get(c).values.to_numpy(zero_copy_only=False) if get(c).values is not None else [], dtype=np.int64) for c in ("ids", "counts"))
            total, kept = get("total").as_py(), get("kept").as_py()
            out.append((get("source").as_py(), (ids, prices(counts, total, kept), int(prices(np.zeros(1, np.int64), total, kept)[0]))))
        return out

    rows: list[tuple[str, str, int]] = []
    lang = None
    if left.num_rows and right.num_rows:
        lang, terms = left.column("lang")[0].as_py(), left.column("terms")[0].as_py()
        same = left.column("tile")[0].as_py() == right.column("tile")[0].as_py()
        a, b = sides(left), sides(right)
        rows = [(x, y, merged(p, q, terms)) for x, p in a for y, q in b if not same or x < y]
    return pa.table({"lang": pa.array([lang] * len(rows), pa.string()), "a": pa.array([r[0] for r in rows], pa.string()), "b": pa.array([r[1] for r in rows], pa.string()), "value": pa.array([r[2] for r in rows], pa.int64())})


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank: all other sources of each group, and its ``top`` most overused terms."""
    each = Window.partitionBy("lang", "term")  # a row for each source
    used = term_counts(docs).withColumns({"_docs": F.sum("docs").over(each), "all_n": F.sum("n").over(each)}).filter(F.col("_docs") >= min_docs)
    used = reliable(used.select("lang", "source", "term", "n", "all_n"))
    kept = used.select("lang", "term", "all_n").distinct()
    groups = reliable(_plain(docs, "lang", "source").distinct())
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    langs = groups.select("lang").distinct().join(size, "lang", "left").fillna(0, ["kept", "all_total"])
    langs = bounded_broadcast(reliable(langs.withColumn("blocks", F.greatest(F.ceil(F.col("kept") / BLOCK), F.lit(1)).cast("long"))))
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    inside = Window.partitionBy("lang", "block").orderBy("term")
    terms = reliable(kept.join(langs, "lang").withColumn("block", block).withColumn("id", F.row_number().over(inside)))
    used = reliable(used.drop("all_n").join(terms, ["lang", "term"]))

    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    tiles = bounded_broadcast(groups.groupBy("lang").agg(F.ceil(F.count("*") / TILE).cast("long").alias("tiles")))
    groups = groups.join(totals, ["lang", "source"], "left").fillna(0, ["total"]).join(langs, "lang").join(tiles, "lang")
    groups = reliable(groups.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))))

    arrays = used.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("pairs"))
    sizes = terms.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    slots = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    slots = slots.join(arrays, ["lang", "source", "block"], "left").join(sizes, ["lang", "block"], "left").fillna(0, ["terms"])
    nothing = F.array().cast("array<struct<id:int,n:bigint>>")
    pairs = F.coalesce("pairs", nothing)
    slots = reliable(slots.select("lang", "source", "block", "tile", "tiles", "total", "kept", "terms", pairs.getField("id").alias("ids"), pairs.getField("n").alias("counts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    spread = slots.withColumn("other", other)
    left = spread.filter("tile <= other").withColumn("t", F.col("tile")).withColumn("u", F.col("other"))
    right = spread.filter("other <= tile").withColumn("t", F.col("other")).withColumn("u", F.col("tile"))
    task = ["lang", "block", "t", "u"]
    sums = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInArrow(_pair_sums, "lang string, a string, b string, value long")
    sums = reliable(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionAll(sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    own = used.join(groups.select("lang", "source", "total"), ["lang", "source"])
    gap = _price(F.col("n"), F.col("total"), F.col("kept")) - _price(F.col("all_n"), F.col("all_total"), F.col("kept"))
    over = own.select("lang", "source", F.col("term").alias("item"), gap.alias("value")).filter("value > 0")
    return ranked(both, "pair").unionAll(ranked(over, "term").filter(F.col("rank") <= top))
