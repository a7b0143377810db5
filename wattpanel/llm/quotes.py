"""Quotation linking: conversations in reply order, without their quotes.

A message's lines are read by quote level (the number of leading ``>``); lines of one level between blank or attribution lines are
a passage.  Passages, their lines and their sentences are normalised (lower case, words only) and hashed.  A quoted passage is joined to the
earliest message of its conversation in which the same passage stands unquoted, and each of its lines and sentences, as well as itself, to the
earliest in which that stands as passage, line or sentence.  At the shallowest linked level the message most of whose whole passages
a message quotes is the one it replies to; if equal (a trimmed quote has none), the one of which it quotes most words, then the latest.  Threads are found by pointer doubling over these
replies; in a conversation, messages are ordered by the turn of their thread's first message, then by turn, so that a reply
follows what it answers.

Messages are named by (conv_id, turn): rows that repeat a name are all kept and share a place.  A null conv_id is a conversation of
its own; a null turn has no place in time, so such messages neither link nor are linked; null text is empty.  A message's own lines keep their indentation and
blank lines.  No step gathers a conversation in one place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import reliable

MARKS = re.compile(r"\s{0,3}((?:>\s?)+)")
ATTRIBUTION = re.compile(r"\s*(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\bécrit|el\b.*\bescribió|.{1,80}\b(?:wrote|writes|said))\s*:\s*$", re.IGNORECASE)
WORDS = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.!?…。！？])\s+")


def _lines(text: str | None) -> list[tuple[int, str, bool]]:
    """(level, line without marks and outer space, whether it ends a passage: blank or attributing the quote after it) in order."""
    lines = []
    for line in (text or "").split("\n"):
        m = MARKS.match(line)
        lines.append((m[1].count(">"), line[m.end() :].strip()) if m else (0, line.strip()))
    out = []
    for i, (depth, line) in enumerate(lines):
        after = next((d for d, x in lines[i + 1 : i + 3] if x), depth)
        out.append((depth, line, not line or bool(after > depth and ATTRIBUTION.match(line))))
    return out


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, passage) in order; attribution lines before a quote are left out."""
    out: list[tuple[int, str]] = []
    now: list[str] = []
    level = 0
    for depth, line, ends in _lines(text):
        if (ends or depth != level) and now:
            out.append((level, "\n".join(now)))
            now = []
        level = depth
        if not ends:
            now.append(line)
    if now:
        out.append((level, "\n".join(now)))
    return out


def unquoted(text: str | None) -> str:
    """The text without quotes and their attribution lines: a message that quotes nothing as it stands, of another its own
    lines as they stand, with one blank line where a quote was and none at either end."""
    read = _lines(text)
    if not any(depth and line for depth, line, _ in read):
        return text or ""
    kept: list[str] = []
    gap = True
    for raw, (depth, line, ends) in zip((text or "").split("\n"), read):
        if depth or ends and line:
            while kept and not kept[-1].strip():
                kept.pop()
            gap = True
        elif line or not gap:
            if gap and kept:
                kept.append("")
            kept.append(raw)
            gap = False
    while kept and not kept[-1].strip():
        kept.pop()
    return "\n".join(kept)


def normal_hash(passage: str) -> int | None:
    """Signed hash of the passage's words in lower case; None if it has none."""
    words = WORDS.findall(passage.lower())
    if not words:
        return None
    h = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"), 7)
    return h - (1 << 64) if h >> 63 else h


def units(passage: str) -> dict[int, tuple[int, bool]]:
    """hash -> (words, whole) of a passage, its lines and its sentences; a line that is the passage counts as whole."""
    out: dict[int, tuple[int, bool]] = {}
    joined = passage.replace("\n", " ")
    for whole, parts in ((True, [passage]), (False, passage.split("\n")), (False, SENTENCE_END.split(joined))):
        for part in parts:
            h = normal_hash(part)
            if h is not None and h not in out:
                out[h] = (len(WORDS.findall(part)), whole)
    return out


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (unquoted), n_quotes, own (whole, hash) and quoted (level, passage, hash, words, whole) of every row."""
    schema = "conv_id long, turn long, role string, text string, n_quotes long, own array<struct<whole:boolean,hash:long>>, quoted array<struct<level:int,passage:long,hash:long,words:long,whole:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_kind = pa.list_(pa.struct([("whole", pa.bool_()), ("hash", pa.int64())]))
        kind = pa.list_(pa.struct([("level", pa.int32()), ("passage", pa.int64()), ("hash", pa.int64()), ("words", pa.int64()), ("whole", pa.bool_())]))
        for batch in batches:
            texts, counts, own, quoted = [], [], [], []
            for value in batch.column(3):
                parts = passages(value.as_py())
                texts.append(unquoted(value.as_py()))
                counts.append(sum(d > 0 for d, _ in parts))
                hashed = [(d, normal_hash(p), units(p)) for d, p in parts]
                mine: dict[int, bool] = {}
                for d, _, us in hashed:
                    for h, (_, whole) in us.items() if d == 0 else ():
                        mine[h] = mine.get(h, False) or whole
                own.append([{"whole": w, "hash": h} for h, w in sorted(mine.items())])
                theirs = sorted({(d, p, h, n, whole) for d, p, us in hashed if d > 0 for h, (n, whole) in us.items()})
                quoted.append([dict(zip(("level", "passage", "hash", "words", "whole"), x)) for x in theirs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(own, own_kind), pa.array(quoted, kind)],
                ["conv_id", "turn", "role", "text", "n_quotes", "own", "quoted"],
            )

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def _conv() -> list[Column]:
    return [F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("nc")]


def replies(parsed: DataFrame) -> DataFrame:
    """c, nc, turn, parent, n_linked: for every message name that quotes an earlier message."""
    timed = parsed.filter("turn is not null")
    wanted = timed.filter("size(quoted) > 0").select(*_conv(), "turn", F.explode("quoted").alias("q")).select("c", "nc", "turn", "q.*").distinct()
    named = wanted.select("c", "nc", "hash").distinct()
    own = timed.select(*_conv(), "turn", F.explode("own").alias("o")).select("c", "nc", "turn", "o.*")
    found = own.join(named, ["c", "nc", "hash"], "left_semi").groupBy("c", "nc", "hash").agg(F.min("turn").alias("any"), F.min(F.when(F.col("whole"), F.col("turn"))).alias("all"))
    # a vote of the whole passage (strong) and one of its words, each for the earliest message that has them
    each = F.array(F.struct(F.lit(False).alias("strong"), F.col("any").alias("origin")), F.struct(F.col("whole").alias("strong"), F.when(F.col("whole"), F.col("all")).alias("origin")))
    links = wanted.join(found, ["c", "nc", "hash"]).select("*", F.explode(each).alias("v")).select("c", "nc", "turn", "level", "passage", "hash", "words", "v.*").filter("origin < turn")
    single = links.groupBy("c", "nc", "turn", "level", "hash", "origin").agg(F.max("words").alias("words"), F.max("strong").cast("long").alias("strong"))
    votes = single.groupBy("c", "nc", "turn", "level", "origin").agg(F.sum("strong").alias("n"), F.sum("words").alias("words"))
    best = F.max(F.struct((-F.col("level")).alias("l"), "n", "words", "origin"))
    linked = links.select("c", "nc", "turn", "level", "passage").distinct().groupBy("c", "nc", "turn").agg(F.count(F.lit(1)).alias("n_linked"))
    chosen = votes.groupBy("c", "nc", "turn").agg(best.alias("b")).select("c", "nc", "turn", F.col("b.origin").alias("parent"))
    return chosen.join(linked, ["c", "nc", "turn"])


def roots(edges: DataFrame) -> DataFrame:
    """c, nc, turn, root, depth from replies (pointer doubling: rounds grow with the logarithm of the longest thread)."""
    state = reliable(edges.select("c", "nc", "turn", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = state.select("c", "nc", F.col("turn").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"))
        step = state.join(up, ["c", "nc", "root"], "left")
        if step.filter("far is not null").isEmpty():
            return state
        state = reliable(step.select("c", "nc", "turn", F.coalesce("far", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, parent_turn, root_turn, depth of every row, range partitioned and
    sorted in reply order (conv_id, root_turn, turn)."""
    parsed = reliable(parse(messages))
    edges = reliable(replies(parsed))
    found = roots(edges).join(edges.select("c", "nc", "turn", "parent", "n_linked"), ["c", "nc", "turn"])
    found = found.select(F.col("c").alias("_c"), F.col("nc").alias("_nc"), F.col("turn").alias("_turn"), "parent", "n_linked", "root", "depth")
    same = (F.coalesce("conv_id", F.lit(0)) == F.col("_c")) & (F.col("conv_id").isNull() == F.col("_nc")) & (F.col("turn") == F.col("_turn"))
    rows = parsed.join(found, same, "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth")
    )
    return rows.repartitionByRange("conv_id", "root_turn", "turn").sortWithinPartitions("conv_id", "root_turn", "turn")
