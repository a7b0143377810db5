"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document has four measures: symbols per word, mean word length, share of repeated lines and share of words in repeated five-word windows.
Their distribution in every (lang, source) group is kept as a sketch: counts in buckets of
at most 1/64 relative width (exact below 128 thousandths).  Sketches merge by adding counts, so
they are pre-aggregated in every task and rolled up from groups to languages and to all
documents.  A group's sketch is blended with its language's, and that with the sketch of all documents: the parent's counts are added, scaled to
``PARENT_DOCS`` documents.  A small group so leans on its parent and a large one on itself, without a size at which the rule changes.
A document fails a measure beyond median + ``SPREAD`` x interquartile range + a margin (word length on either side).

All arithmetic is on integers (thousandths), so results do not depend on order or engine.  Null text has no words; a null lang or source is a
group of its own; documents without words are left out of the sketches and fail the base rule; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, reliable, text_or_empty

MEASURES = ("symbols", "length", "lines", "repeats")
MARGINS = {"symbols": 150, "length": 1500, "lines": 350, "repeats": 100}  # thousandths
SPREAD = 3
PARENT_DOCS = 50  # what a parent's sketch weighs beside a group's own documents
_PPM = 1_000_000
BROADCAST_GROUPS = 100_000


def _windows(width: int) -> str:
    at = ", ".join(f"get(h, i + {j})" for j in range(width))
    return f"if(size(w) < {width}, cast(array() as array<bigint>), transform(array(transform(w, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {width}), i -> xxhash64({at})))[0])"


def _covered(width: int) -> str:
    """SQL: words covered by windows whose hash in ``windows`` occurs twice or more."""
    twice = (
        "transform(array(array_sort(transform(windows, (v, i) -> named_struct('v', v, 'i', i)))), s -> array_sort(transform("
        "filter(s, (e, k) -> (k > 0 and get(s, k - 1).v = e.v) or (k < size(s) - 1 and get(s, k + 1).v = e.v)), e -> e.i)))[0]"
    )
    walk = f"aggregate(p, named_struct('n', 0L, 'to', 0), (a, i) -> named_struct('n', a.n + i + {width} - greatest(a.to, i), 'to', i + {width}), a -> a.n)"
    return f"if(size(array_distinct(windows)) = size(windows), 0L, transform(array({twice}), p -> {walk})[0])"


def measures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines of every row."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "lang",
        "source",
        F.array_remove(F.split(text, WORD_GAP), "").alias("w"),
        lines.alias("lines"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    cut = cut.withColumn("windows", F.expr(_windows(width)))
    return cut.select(
        "doc_id",
        "lang",
        "source",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_covered(width)).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def _thousandths() -> Column:
    """One struct for each measure; only for rows with words."""
    one = lambda name, over, by: F.struct(F.lit(name).alias("measure"), F.expr(f"(1000 * {over}) div {by}").alias("x"))
    return F.array(one("symbols", "n_symbols", "n_words"), one("length", "word_chars", "n_words"), one("lines", "n_dup_lines", "n_lines"), one("repeats", "n_repeat_words", "n_words"))


def sketch(measured: DataFrame) -> DataFrame:
    """lang, source, measure, bucket (its lower edge, in thousandths) and n."""
    rows = measured.filter("n_words > 0").select("lang", "source", F.explode(_thousandths()).alias("m")).select("lang", "source", "m.measure", "m.x")
    bucket = F.expr("shiftleft(shiftright(x, greatest(0, length(bin(x)) - 7)), greatest(0, length(bin(x)) - 7))")
    return rows.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by``, measure, docs, q1, q2, q3 of the merged sketches."""
    merged = sketches.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    bins = merged.groupBy(*by, "measure").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("docs"))
    at = "aggregate(b, named_struct('n', 0L, 'q', cast(null as bigint)), (a, x) -> named_struct('n', a.n + x.n, 'q', if(a.q is null and 4 * (a.n + x.n) >= {k} * docs, x.bucket, a.q)), a -> a.q)"
    return bins.select(*by, "measure", "docs", *[F.expr(at.format(k=k)).alias(f"q{k}") for k in (1, 2, 3)])


def _marked(name: str) -> Column:
    """A column without nulls that tells a null from every text."""
    return F.when(F.col(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(name)))


def blended(sketches: DataFrame, weight: int = PARENT_DOCS) -> DataFrame:
    """lang, source, measure, bucket and n: each group's counts in millionths of documents, its parents' shares added at their weight."""
    counts = sketches.select(_marked("lang").alias("l"), _marked("source").alias("s"), "lang", "source", "measure", "bucket", "n")
    whole = counts.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))
    total = whole.groupBy("measure").agg(F.sum("n").alias("total"))
    share = whole.join(total, "measure").select("measure", "bucket", F.expr(f"n * {_PPM}L div total").alias("share"))
    for keys in (["l"], ["l", "s"]):
        own = counts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
        groups = own.select(*keys, "measure").distinct()
        parent = [k for k in keys[:-1]] + ["measure"]
        mixed = groups.join(share, parent).join(own, [*keys, "measure", "bucket"], "left")
        mixed = mixed.select(*keys, "measure", "bucket", (F.coalesce("n", F.lit(0)) * _PPM + weight * F.col("share")).alias("n")).filter("n > 0")
        total = mixed.groupBy(*keys, "measure").agg(F.sum("n").alias("total"))
        share = mixed.join(total, [*keys, "measure"]).select(*keys, "measure", "bucket", F.expr(f"n div (total div {_PPM}L + 1)").alias("share"))
    names = counts.select("l", "s", "lang", "source").distinct()
    return mixed.join(names, ["l", "s"]).select("lang", "source", "measure", "bucket", "n")


def thresholds(sketches: DataFrame, spread: int = SPREAD, weight: int = PARENT_DOCS) -> DataFrame:
    """lang, source and, for each measure, the least and the largest value that passes (thousandths)."""
    rows = _quartiles(blended(sketches, weight), ["lang", "source"])
    margin = F.element_at(F.create_map(*[x for m in MEASURES for x in (F.lit(m), F.lit(MARGINS[m]))]), F.col("measure"))
    width = spread * (F.col("q3") - F.col("q1")) + margin
    rows = rows.select("lang", "source", "measure", (F.col("q2") - width).alias("low"), (F.col("q2") + width).alias("high"))
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("low", "high")]
    )


def judged(docs: DataFrame, spread: int = SPREAD, weight: int = PARENT_DOCS) -> DataFrame:
    """The measures of every row, base_failed and kept."""
    measured = reliable(measures(docs))
    limits = reliable(thresholds(reliable(sketch(measured)), spread, weight)).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{m}_{s}" for m in MEASURES for s in ("low", "high")])
    if limits.count() <= BROADCAST_GROUPS:  # ten numbers for each (lang, source); beyond, a shuffle join
        limits = F.broadcast(limits)
    rows = measured.join(limits, measured["lang"].eqNullSafe(F.col("_lang")) & measured["source"].eqNullSafe(F.col("_source")), "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    value = {"symbols": "(1000 * n_symbols) div n_words", "length": "(1000 * word_chars) div n_words", "lines": "(1000 * n_dup_lines) div n_lines", "repeats": "(1000 * n_repeat_words) div n_words"}
    passes = F.lit(True)
    for m in MEASURES:
        passes = passes & (F.expr(value[m]) <= F.col(f"{m}_high"))
    passes = passes & (F.expr(value["length"]) >= F.col("length_low"))
    kept = F.when(base, False).otherwise(F.coalesce(passes, F.lit(False)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))
