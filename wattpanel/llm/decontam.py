"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: the words under its ones are hashed, those under its
zeros are ignored, so a substituted word does not spoil every hash around it.  The seed hashes of all documents are joined
with those of the benchmark items; each hit fixes an alignment (document position minus item position), which is verified by comparing
the words of the whole item at that alignment: a window of ``WINDOW`` words (the item's length
if shorter) must agree in at least ``SHARE`` of its words.

The masks of an item follow from its length: a family in ``FAMILIES`` hits every pattern of so many changed words in a window of
so many, and where none fits, a run of ones as long as the changes must leave whole somewhere.  So whatever the verification
accepts has a seed in common with its item, in items of any length.

Words are runs of letters, digits and non-ASCII characters, in lower case.  Null or empty text has no words; items of fewer than
``min_words`` words (1: none but the empty) are not searched; items with a null id are
reported with a null id; repeated identical rows (same doc_id and text) give one row for each item.
The benchmark is broadcast in blocks of items whose seeds stay under ``BLOCK_ROWS`` rows, however large it is: the seeds with the number of
their item, and beside them each item's words once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_NAME, packed, reliable, row_name, text_key, text_or_empty, unpacked

#: (words, changed words) -> masks of which one, somewhere in so many words, has no changed word under its ones, wherever the changes lie.
FAMILIES = {
    (15, 3): ("1011100101", "10100010111", "11000101000101"),
    (10, 2): ("11001101", "1101011", "101010011"),
    (5, 1): ("111", "11011"),
}
WINDOW = 15
SHARE = 0.8
BLOCK_ROWS = 1_000_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def least_equal(length: int, share: float = SHARE) -> int:
    """Words of ``length`` that must agree."""
    return math.ceil(length * share)


def masks_for(length: int, share: float = SHARE) -> tuple[str, ...]:
    """Masks that hit every pattern of changes that ``share`` allows in a window of ``length`` words."""
    changed = length - least_equal(length, share)
    if changed >= length:
        raise ValueError("share must ask for a word at least")
    able = [k for k in FAMILIES if changed and k[0] <= length and k[1] >= changed]
    if able:
        return FAMILIES[max(able)]
    return ("1" * -(-(length - changed) // (changed + 1)),)


def _seeds(frame: DataFrame, masks: dict[str, Column | None]) -> DataFrame:
    """``frame`` with hw -> a row for each placement of each mask (where its condition holds): at (the word at which it starts) and seed.

    Positions are exploded and seeds hashed from ``hw`` by generated code, not by lambda functions.
    """
    placed = frame.select("*", F.posexplode("hw").alias("at", "_w"))
    seeds = []
    for mask, only in masks.items():
        fits = F.col("at") <= F.size("hw") - len(mask)
        words = [F.get("hw", F.col("at") + j) for j, c in enumerate(mask) if c == "1"]
        seeds.append(F.when(fits if only is None else fits & only, F.xxhash64(F.lit(mask), *words)))
    return placed.select(*frame.columns, "at", F.explode(F.array(*seeds)).alias("seed")).filter("seed is not null")


def _agreement(window: int) -> str:
    """SQL: most equal words in any ``window`` consecutive words of the aligned item (words outside the document differ)."""
    same = "transform(sequence(0, size(iw) - 1), k -> if(k + lead < 0, 0, if(get(dw, k + least(lead, 0)) <=> get(iw, k), 1, 0)))"
    run = (
        f"aggregate(sequence(0, size(e) - 1), named_struct('now', 0, 'best', 0), (a, k) -> named_struct("
        f"'now', a.now + get(e, k) - if(k >= {window}, get(e, k - {window}), 0), "
        f"'best', greatest(a.best, a.now + get(e, k) - if(k >= {window}, get(e, k - {window}), 0))), a -> a.best)"
    )
    return f"transform(array({same}), e -> {run})[0]"


def _item_blocks(items: DataFrame, n_masks: int, block_rows: int) -> list[DataFrame]:
    """The items in blocks of at most about ``block_rows`` seeds, by a hash."""
    words = items.agg(F.sum(F.size("hw"))).first()[0] or 0
    n = -(-words * n_masks // block_rows)
    if n <= 1:
        return [items]
    block = F.pmod(F.xxhash64(F.lit("block"), "item"), F.lit(2 * n))
    return [items.filter(block == i) for i in range(2 * n)]


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, block_rows: int = BLOCK_ROWS, min_words: int = 1) -> DataFrame:
    """doc_id, _k1, _k2, item_id, first_word, item_words, matched (equal words in the best window) and overlap (their share)."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), _word_hashes(text_or_empty()).alias("hw"))
    items = benchmark.select("item_id", _word_hashes(text_or_empty()).alias("hw")).filter(F.size("hw") >= max(1, min_words)).distinct()
    items = reliable(items.withColumn("item", F.xxhash64(F.col("item_id").isNull(), "item_id", "hw")))
    length = F.least(F.size("hw"), F.lit(window))
    present = sorted(r[0] for r in items.select(length.alias("n")).distinct().collect())  # at most window rows
    lengths: dict[str, list[int]] = {}
    for n in present or [window]:
        for mask in masks_for(n, share):
            lengths.setdefault(mask, []).append(n)
    masks = {mask: length.isin(ns) for mask, ns in lengths.items()}
    rows = _seeds(named, dict.fromkeys(masks))
    out = None
    for block in _item_blocks(items, len(masks), block_rows):
        probes = _seeds(block, masks).select("seed", "item", F.col("at").alias("item_at"), F.size("hw").alias("words")).distinct()
        hits = rows.join(F.broadcast(probes), "seed").withColumn("lead", F.col("at") - F.col("item_at"))
        near = F.slice("hw", F.greatest(F.col("lead"), F.lit(0)) + 1, F.col("words"))
        hits = hits.select("doc_id", "_k1", "_k2", "item", "lead", near.alias("dw"))
        hits = hits.groupBy("doc_id", "_k1", "_k2", "item", "lead").agg(F.first("dw").alias("dw"))
        hits = hits.join(F.broadcast(block.select("item", "item_id", F.col("hw").alias("iw"))), "item")
        found = hits.withColumn("matched", F.expr(_agreement(window))).withColumn("length", F.least(F.size("iw"), F.lit(window)))
        found = found.filter(F.col("matched") >= F.ceil(F.col("length") * share))
        found = found.groupBy("doc_id", "_k1", "_k2", "item_id").agg(
            F.max(F.struct((F.col("matched") / F.col("length")).alias("overlap"), (-F.col("lead")).alias("back"), "matched", F.size("iw").alias("item_words"))).alias("b")
        )
        found = found.select(
            "doc_id", "_k1", "_k2", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.item_words").alias("item_words"), F.col("b.matched").alias("matched"), F.col("b.overlap").alias("overlap")
        )
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item; columns unchanged."""
    found = overlaps(docs, benchmark, **options)
    hit = reliable(found.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "_k1", "_k2").distinct())
    return docs.select(packed(docs), *row_name()).join(hit, ROW_NAME, "left_anti").select(*unpacked(docs))
