"""Registered queries of the text operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, html_blocks, importance, langmix, license_scan, mixing, quality_rules, quotes, secret_scan, simhash, target_draw
from .common import read


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document and whether Gumbel top-k keeps it."""
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "log_weight", "kept")


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair with a verified overlap."""
    found = decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "item_words", "matched", "overlap")


def op3_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns and random tokens."""
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op4_block_text_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_blocks.extract(read(spark, sf_dir, "pages"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, in reply order."""
    return quotes.link(read(spark, sf_dir, "conversations"))


def op6_mixture_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose fold is not held out."""
    docs = read(spark, sf_dir, "documents")
    held = langmix.fold() == 2
    labelled = docs.filter(F.col("lang").isNotNull() & ~held).select("doc_id", "lang", "text")
    found = langmix.identify(docs, labelled)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op7_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and the verdict of its group's adaptive thresholds."""
    return quality_rules.judged(read(spark, sf_dir, "documents"))


def op8_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.plan(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_diagonal_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and license labels of every document."""
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of ids, digest of the ids and digest of the decoded text of every document."""
    import public_tokenizers

    docs, file = read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    found = bpe.encode(docs, file, bpe.fit(docs, file), decoded=True)
    digits = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_target_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain weight, perturbed score and rank of every document towards the benchmark's words."""
    found = target_draw.draw(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language and the terms that each source overuses."""
    return divergence.audit(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_spaced_seed_decontamination,
        op3_randomness_secret_scan,
        op4_block_text_extraction,
        op5_quotation_linking,
        op6_mixture_language_id,
        op7_adaptive_quality_rules,
        op8_hypergeometric_mixing,
        op9_golay_simhash,
        op10_diagonal_license_scan,
        op11_transducer_bpe,
        op12_target_importance_draw,
        op13_source_divergence,
    )
}

_MEASURE = {"symbols": "(1000 * n_symbols) // n_words", "length": "(1000 * word_chars) // n_words", "lines": "(1000 * n_dup_lines) // n_lines", "repeats": "(1000 * n_repeat_words) // n_words"}
_MARGIN = {"symbols": 150, "length": 1500, "lines": 350, "repeats": 100}
_LONG = " UNION ALL ".join(f"SELECT rid, lang, source, '{m}' AS measure, {x} AS x FROM base WHERE n_words > 0" for m, x in _MEASURE.items())


def _blend(name: str, keys: str, parent: str) -> str:
    """SQL of a level of the blended sketches: groups by ``keys`` (comma-separated), the shares of the level above in ``parent``."""
    by = f"{keys}, measure"
    up = " AND ".join(f"g.{k} IS NOT DISTINCT FROM p.{k}" for k in [*keys.split(", ")[:-1], "measure"])
    same = " AND ".join(f"c.{k} IS NOT DISTINCT FROM g.{k}" for k in by.split(", ")) + " AND c.bucket = p.bucket"
    cols = ", ".join(f"g.{k}" for k in by.split(", "))
    return f"""{name}_c AS (SELECT {by}, bucket, count(*) AS n FROM bucketed GROUP BY ALL),
{name}_m AS (SELECT {cols}, p.bucket, coalesce(c.n, 0) * 1000000 + 50 * p.share AS n FROM (SELECT DISTINCT {by} FROM bucketed) g JOIN {parent} p ON {up}
        LEFT JOIN {name}_c c ON {same}),
{name} AS (SELECT *, n // (sum(n) OVER (PARTITION BY {by})::BIGINT // 1000000 + 1) AS share, sum(n) OVER (PARTITION BY {by} ORDER BY bucket)::BIGINT AS upto,
        sum(n) OVER (PARTITION BY {by})::BIGINT AS total FROM {name}_m WHERE n > 0)"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op7_adaptive_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
u AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
win AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g
        FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win WHERE g IS NOT NULL) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines FROM w LEFT JOIN rep ON w.rid = rep.rid),
long AS ({_LONG}),
bucketed AS (SELECT rid, lang, source, measure, x, (x >> greatest(0, length(bin(x)) - 7)::BIGINT) << greatest(0, length(bin(x)) - 7)::BIGINT AS bucket FROM long),
whole AS (SELECT measure, bucket, n * 1000000 // sum(n) OVER (PARTITION BY measure)::BIGINT AS share FROM (SELECT measure, bucket, count(*) AS n FROM bucketed GROUP BY ALL)),
{_blend("bylang", "lang", "whole")},
{_blend("own", "lang, source", "bylang")},
limits AS (SELECT lang, source, measure, {", ".join(f"min(bucket) FILTER (WHERE 4 * upto >= {k} * total) AS q{k}" for k in (1, 2, 3))} FROM own GROUP BY ALL),
margins AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {v})" for m, v in _MARGIN.items())}) t(measure, margin)),
passed AS (SELECT rid, bool_and(x <= q2 + 3 * (q3 - q1) + margin AND (long.measure <> 'length' OR x >= q2 - 3 * (q3 - q1) - margin)) AS ok
        FROM long JOIN limits ON long.lang IS NOT DISTINCT FROM limits.lang AND long.source IS NOT DISTINCT FROM limits.source AND long.measure = limits.measure
        JOIN margins ON long.measure = margins.measure GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(ok, false) AS kept
FROM base LEFT JOIN passed ON base.rid = passed.rid""",
    "op8_hypergeometric_mixing": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), CASE WHEN source IS NULL THEN '-' ELSE concat_ws(':', length(source)::VARCHAR, source) END, coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
v AS (SELECT *, (rank % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
f AS (SELECT *, ((SELECT sum(source_size) FROM v)::DOUBLE - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(weight) FROM v) - coalesce(sum(weight) OVER b, 0)) AS level
        FROM v WINDOW b AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
line AS (SELECT max(level) FILTER (WHERE most >= weight * level) AS line FROM f),
t AS (SELECT source, rank, source_size, least(most, weight * coalesce(line, 0)) AS target FROM f, line),
r AS (SELECT d.*, t.rank, t.source_size, t.target, substr(k, 1, 3) AS block,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT rank, block, sum(size)::BIGINT AS words, any_value(floor(target - whole * source_size + 0.5))::BIGINT AS goal FROM r GROUP BY rank, block),
c AS (SELECT rank, block, words, goal - coalesce(sum(words) OVER (PARTITION BY rank ORDER BY md5(concat_ws('|', 'mix-1', rank::VARCHAR, block)), block
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM b),
g AS (SELECT r.*, c.rest, c.words, count(*) OVER same AS n, sum(size) OVER (PARTITION BY r.rank, r.block ORDER BY k RANGE UNBOUNDED PRECEDING) - sum(size) OVER same AS before
        FROM r JOIN c ON r.rank = c.rank AND r.block = c.block WINDOW same AS (PARTITION BY r.rank, r.block, k))
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN rest <= 0 THEN 0 WHEN rest >= words THEN size ELSE greatest(0, least(n * size, rest - before)) // n END)::BIGINT AS taken FROM g""",
    "op12_target_importance_draw": rf"""
WITH low AS (SELECT row_number() OVER () AS rid, 0 AS kind, doc_id, {_LOWERED} AS text FROM documents
    UNION ALL SELECT row_number() OVER (), 1, NULL, {_LOWERED} FROM benchmark),
cut AS (SELECT *, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM low),
u AS (SELECT rid, kind, unnest(words) AS word FROM cut),
bits AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS steps FROM range(256) r(i)),
octets AS (SELECT word, [list_position(['0','1','2','3','4','5','6','7','8','9','A','B','C','D','E','F'], h[2 * k - 1]) * 16 + list_position(['0','1','2','3','4','5','6','7','8','9','A','B','C','D','E','F'], h[2 * k]) - 17
        FOR k IN range(1, length(h) // 2 + 1)] AS bytes FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM u))),
crc AS (SELECT word, xor(4294967295, list_reduce(bytes, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket FROM octets, bits),
f AS (SELECT rid, kind, bucket FROM u JOIN crc USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE kind = 0) AS s, count(*) FILTER (WHERE kind = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS gain FROM n),
w AS (SELECT rid, count(*)::BIGINT AS n_features, sum(gain)::BIGINT AS total FROM f JOIN g USING (bucket) WHERE kind = 0 GROUP BY rid),
h AS (SELECT cut.rid, doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (total - ((total % n_features) + n_features) % n_features) // n_features END AS weight,
        ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM cut LEFT JOIN w ON cut.rid = w.rid WHERE kind = 0),
k AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296.0::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM k)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM k WHERE n_features >= 20) // 100 THEN place END::BIGINT AS rank FROM r""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS text FROM documents),
u AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM u GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT l.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON l.lang = k.lang GROUP BY l.lang),
c AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM u JOIN kept k ON u.lang = k.lang AND u.term = k.term GROUP BY ALL),
gr AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::BIGINT AS total FROM gr g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
price AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * v.v) AS p
    FROM tot t JOIN v ON t.lang = v.lang JOIN kept k ON t.lang = k.lang LEFT JOIN c ON t.lang = c.lang AND t.source = c.source AND k.term = c.term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS q FROM (SELECT c.lang, c.term, sum(n) AS n, any_value(v.v) AS v, any_value(s.total) AS total
    FROM c JOIN v ON c.lang = v.lang JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) s ON c.lang = s.lang GROUP BY c.lang, c.term)),
pairs AS (SELECT a.lang, a.source, b.source AS item FROM gr a JOIN gr b ON a.lang = b.lang AND a.source <> b.source),
diff AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p))::BIGINT AS value FROM price x JOIN price y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
every AS (SELECT p.lang, p.source, 'pair' AS part, p.item, coalesce(value, 0)::BIGINT AS value FROM pairs p LEFT JOIN diff ON p.lang = diff.lang AND p.source = diff.source AND p.item = diff.item
    UNION ALL SELECT x.lang, x.source, 'term', x.term, (p - q)::BIGINT FROM price x JOIN q ON x.lang = q.lang AND x.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every) WHERE part = 'pair' OR rank <= 50""",
}
