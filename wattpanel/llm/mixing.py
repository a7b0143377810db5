"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into 4,096 blocks by a hash of its rows, so a block holds a fixed share
of its source at any scale and a hot source is spread like any other.  A source whose target is r times
its words gives floor(r) draws of every block and further draws of blocks, in a random order, up to the
target; the last block is cut at the word (identical rows there share equally).  The draws are split among output shards by a binary
tree: a node hands its left child half of its draws, and how many of them come from each source is drawn from the
multivariate hypergeometric distribution (source by source, each conditional on the ones before), so leaf quotas add up
exactly.  A leaf then takes its next unused blocks in each source's random order, and rows are shuffled inside the shard by hash order.

Tables of sources, nodes and blocks are bounded by (sources x 4,096) and independent of the number of rows.
Null text has no word; a null source is a source of its own, last in order; identical rows are treated alike and each
counts; a source without words has target 0; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP, packed, reliable, text_or_empty, unpacked

MAX_REPEATS = 3
SHARDS = 16
SEED = "mix-1"


def _size(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, WORD_GAP), "")).cast("long")


def _key() -> Column:
    """A hash that names a row's id, source and text; the source has its length before it or a mark for null, so parts cannot run together."""
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat_ws(":", F.length("source").cast("string"), F.col("source")))
    return F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), source, text_or_empty()))


def _sources(sized: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """source, rank, source_size, target: weights repeat over the sources in order; a target stops at
    ``MAX_REPEATS`` times its source and the excess goes to the others by weight."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MAX_REPEATS))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("words", F.sum("source_size").over(every))
        .withColumn("all_weight", F.sum("weight").over(every))
        .withColumn("most_before", F.coalesce(F.sum("most").over(filled), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
        .withColumn("level", (F.col("words") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("open", F.when(F.col("most") >= F.col("weight") * F.col("level"), F.col("level")))
        .withColumn("line", F.max("open").over(every))
    )
    return level.select("source", "rank", "source_size", F.least(F.col("most"), F.col("weight") * F.coalesce("line", F.lit(0.0))).alias("target"))


def _draws(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """rank, block, words, whole (full copies), extra ('all', 'cut' or 'none'), rest (words to take of a cut block)."""
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    blocks = blocks.join(F.broadcast(sources), blocks["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    blocks = blocks.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    order = Window.partitionBy("rank").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), "rank", "block")), "block").rowsBetween(Window.unboundedPreceding, -1)
    left = F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long") - F.coalesce(F.sum("words").over(order), F.lit(0))
    blocks = blocks.withColumn("rest", left)
    extra = F.when(F.col("rest") <= 0, "none").when(F.col("rest") >= F.col("words"), "all").otherwise("cut")
    return blocks.select("rank", "block", "words", "whole", extra.alias("extra"), "rest")


def _hypergeometric(n: str, q: str, m: str, u: str) -> str:
    """SQL for one draw: of ``m`` items taken from ``n``, how many are among ``q`` marked ones.

    Inversion over the values in the order mode, mode + 1, ..., then mode - 1, ...; terms beyond ten standard deviations are under 1e-20.
    """
    up = "h.p * (({q} - x) * ({m} - x)) / ((x + 1) * ({n} - {q} - {m} + x + 1))".format(n=n, q=q, m=m)
    down = "h.p * (x * ({n} - {q} - {m} + x)) / (({q} - x + 1) * ({m} - x + 1))".format(n=n, q=q, m=m)
    bounds = (
        f"named_struct('lo', greatest(0L, {m} - ({n} - {q})), 'hi', least({q}, {m}), "
        f"'mid', cast(floor(({m} + 1.0D) * ({q} + 1.0D) / ({n} + 2.0D)) as bigint), "
        f"'w', cast(ceil(10 * sqrt(cast({m} as double) * {q} / greatest({n}, 1L) * ({n} - {q}) / greatest({n}, 1L)) + 10) as bigint))"
    )
    return f"""transform(transform(array({bounds}), g -> named_struct('mid', greatest(g.lo, least(g.hi, g.mid)),
          'a', greatest(g.lo, greatest(g.lo, least(g.hi, g.mid)) - g.w), 'b', least(g.hi, greatest(g.lo, least(g.hi, g.mid)) + g.w))),
        r -> transform(array(named_struct(
            'up', aggregate(sequence(r.mid, r.b), named_struct('p', 1.0D, 's', 0.0D), (h, x) -> named_struct('p', {up}, 's', h.s + h.p), h -> h.s),
            'down', aggregate(sequence(r.mid, r.a, -1L), named_struct('p', 1.0D, 's', 0.0D), (h, x) -> named_struct('p', {down}, 's', h.s + if(x < r.mid, h.p, 0.0D)), h -> h.s))),
          z -> coalesce(
            aggregate(sequence(r.mid, r.b), named_struct('p', 1.0D, 's', 0.0D, 'k', cast(null as bigint)),
              (h, x) -> named_struct('p', {up}, 's', h.s + h.p, 'k', if(h.k is null and h.s + h.p > {u} * (z.up + z.down), x, h.k)), h -> h.k),
            aggregate(sequence(r.mid, r.a, -1L), named_struct('p', 1.0D, 's', z.up, 'k', cast(null as bigint)),
              (h, x) -> named_struct('p', {down}, 's', h.s + if(x < r.mid, h.p, 0.0D), 'k', if(h.k is null and x < r.mid and h.s + h.p > {u} * (z.up + z.down), x, h.k)), h -> h.k),
            r.mid))[0])[0]"""


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, quota) -> (shard, rank, quota): the leaves of the splitting tree; ``shards`` is a power of two."""
    if shards & (shards - 1) or shards < 1:
        raise ValueError("shards must be a power of two")
    root = quotas.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(F.lit(1).cast("long").alias("node"), "q")
    nodes = root.filter(F.size("q") > 0).select("node", F.expr("transform(q, x -> x.quota)").alias("q"), F.expr("transform(q, x -> x.rank)").alias("ranks"))
    uniform = f"conv(substring(md5(concat_ws('|', '{SEED}', 'tree', node, y.i)), 1, 12), 16, 10) / 281474976710656.0D"
    step = _hypergeometric("acc.n", "y.v", "acc.m", f"({uniform})")
    left = f"""aggregate(transform(q, (v, i) -> named_struct('v', v, 'i', i)),
        named_struct('n', aggregate(q, 0L, (a, v) -> a + v), 'm', aggregate(q, 0L, (a, v) -> a + v) div 2, 'out', cast(array() as array<bigint>)),
        (acc, e) -> transform(transform(array(e), y -> named_struct('v', y.v, 'x', {step})),
            k -> named_struct('n', acc.n - k.v, 'm', acc.m - k.x, 'out', concat(acc.out, array(k.x))))[0], acc -> acc.out)"""
    for _ in range(shards.bit_length() - 1):
        halves = f"transform(array({left}), l -> array(named_struct('node', node * 2, 'q', l), named_struct('node', node * 2 + 1, 'q', zip_with(q, l, (a, b) -> a - b))))[0]"
        nodes = nodes.select("ranks", F.explode(F.expr(halves)).alias("h")).select(F.col("h.node").alias("node"), F.col("h.q").alias("q"), "ranks")
    leaves = nodes.select((F.col("node") - shards).alias("shard"), F.explode(F.arrays_zip("ranks", "q")).alias("z"))
    return leaves.select("shard", F.col("z.ranks").alias("rank"), F.col("z.q").alias("quota"))


def _assigned(draws: DataFrame, shards: int) -> DataFrame:
    """rank, block, whole, extra, rest and shards: the shard of each draw of the block, copies in order."""
    each = draws.filter("words > 0").withColumn("copies", F.col("whole") + F.when(F.col("extra") == "none", 0).otherwise(1))
    each = each.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    leaves = split_quotas(each.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")), shards)
    ends = leaves.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("l"))
    ends = ends.select("rank", F.expr("transform(sequence(1, size(l)), k -> aggregate(slice(l, 1, k), 0L, (a, x) -> a + x.quota))").alias("ends"))
    order = Window.partitionBy("rank").orderBy(F.md5(F.concat_ws("|", F.lit(SEED), F.lit("draw"), "rank", "block", "copy")), "block", "copy")
    placed = each.withColumn("p", F.row_number().over(order)).join(F.broadcast(ends), "rank")
    placed = placed.withColumn("shard", F.expr("size(filter(ends, e -> e < p))"))
    return placed.groupBy("rank", "block").agg(F.expr("transform(array_sort(collect_list(struct(copy, shard))), x -> x.shard)").alias("shards"))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, whole, extra (words), shards, and _key (the row's hash).

    ``taken`` = whole * size + extra; ``shards`` has the shard of each whole copy, then that of the extra one.
    """
    sized = reliable(docs.select("doc_id", "source", _size(text_or_empty()).alias("size"), _key().alias("_key")).withColumn("block", F.substring("_key", 1, 3)))
    sources = reliable(_sources(sized, weights))
    draws = reliable(_draws(sized, sources))
    blocks = draws.join(_assigned(draws, shards), ["rank", "block"], "left").drop("words")
    rows = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).join(blocks, ["rank", "block"])
    cut = rows.filter("extra = 'cut'").drop("extra")
    same = cut.groupBy("rank", "_key").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("each"), F.max("rest").alias("goal"))
    before = Window.partitionBy("rank").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    free = F.col("goal") - F.coalesce(F.sum(F.col("n") * F.col("each")).over(before), F.lit(0))
    share = F.expr("greatest(0L, least(n * each, free)) div n")  # identical rows get equal shares
    cut = cut.join(same.withColumn("free", free).select("rank", "_key", share.alias("extra")), ["rank", "_key"])
    full = rows.filter("extra <> 'cut'").withColumn("extra", F.when(F.col("extra") == "all", F.col("size")).otherwise(F.lit(0)).cast("long"))
    both = full.unionByName(cut)
    return both.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "whole", "extra", "shards", "_key")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), shards: int = SHARDS) -> DataFrame:
    """The mixed rows: the columns of ``docs`` (text cut in a partial copy), then mix_shard, mix_copy, mix_words and mix_order.

    Rows are range partitioned and sorted by (mix_shard, mix_order): each shard in its local random order.  Columns of ``docs`` that
    have one of the four names give way to them.
    """
    chosen = plan(docs, weights, shards).filter("taken > 0").select("_key", "size", "whole", "extra", "shards").distinct()
    rows = docs.select(packed(docs.drop("text")), "text", _key().alias("_key")).join(chosen, "_key")
    rows = rows.withColumn("mix_copy", F.explode(F.expr("sequence(1L, whole + if(extra > 0, 1, 0))")))
    words = F.when(F.col("mix_copy") <= F.col("whole"), F.col("size")).otherwise(F.col("extra"))
    rows = rows.withColumn("mix_words", words).withColumn("mix_shard", F.expr("get(shards, cast(mix_copy - 1 as int))"))
    lead = F.when(F.col("text").rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    pieces = F.split("text", WORD_GAP, F.col("mix_words").cast("int") + 1 + F.col("lead"))
    cut = F.left("text", F.length("text") - F.length(F.element_at("pieces", -1)))
    partial = rows.filter("mix_words < size").withColumn("lead", lead).withColumn("pieces", pieces).withColumn("text", cut).drop("lead", "pieces")
    rows = rows.filter("mix_words >= size").unionByName(partial)
    rows = rows.withColumn("mix_order", F.xxhash64(F.lit(SEED), "_key", "mix_copy", "mix_shard"))
    own = [F.col(c) for c in ("mix_shard", "mix_copy", "mix_words", "mix_order")]
    out = rows.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    return out.select(*unpacked(docs.drop("mix_shard", "mix_copy", "mix_words", "mix_order"), text=F.col("text")), *own)
