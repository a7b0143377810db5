"""BPE encoding and decoding with a transducer of frequent words.

Texts are normalised and cut into words as the tokenizer file says.  ``fit`` counts the words of all documents in Spark, takes the
most frequent ones (at most ``LEXICON_WORDS``, a bound on the file and on what reaches the driver), merges them once and
compiles them into a minimal acyclic transducer (``transducer``), a file in the shared folder that Spark hands to the
executors, where tasks memory-map it.  ``encode`` walks all distinct words of a piece of text through it together;
words that it does not know are merged by rank, so the ids never depend on which words are frequent.

The file must be a BPE of words with an end-of-word suffix after an NFC, white-space and lower-case normaliser and a byte-level
alphabet, without decoder; another kind raises ValueError.  Special tokens are found in the raw text, as the tokenizers library does.

Null and empty texts give no ids and decode to an empty text; a text of any length is cut at white space into pieces of about
``PIECE`` characters, so memory beyond the ids follows the longest word; repeated rows get equal ids; words equally frequent at the
bound are all left out; an empty table gives an empty lexicon.  Only doc_id and text are read, so further columns never clash.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import transducer
from .common import reliable, text_or_empty

LEXICON_WORDS = 65_536
LONGEST_WORD = 64  # bytes of a word of the lexicon
PIECE = 1 << 22  # characters that are encoded together
_NEVER = np.iinfo(np.int32).max


def read_spec(path: str) -> dict[str, Any]:
    """The tokenizer file's settings; ValueError if they are of another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec.get("normalizer") or {}
    kinds = [x["type"] for x in steps.get("normalizers", [])]
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    fits = (
        model["type"] == "BPE"
        and model.get("end_of_word_suffix")
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and kinds == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and cut[0]["behavior"] == "Removed"
        and cut[0]["invert"]
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and spec.get("decoder") is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].split() != [t["content"]] for t in spec["added_tokens"])
    )
    if not fits:
        raise ValueError(f"{path}: not a lower-casing BPE of words with an end-of-word suffix and a byte-level alphabet")
    return spec


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: Latin-1's printable ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Rules:
    """What a task needs of a tokenizer file: tokens by id, merges as ids, ids of single bytes, special tokens, settings of the cut."""

    def __init__(self, spec: dict[str, Any]):
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.last = [vocab[c + suffix] for c in alphabet]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        tokens: list[str | None] = [None] * size
        for token, at in [*vocab.items(), *self.specials.items()]:
            tokens[at] = token
        self.tokens = [t.encode() if t is not None else None for t in tokens]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Ids of one word: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        if len(ids) > LONGEST_WORD:
            return self._merge_long(ids)
        merges = self.merges
        while len(ids) > 1:
            best = at = None
            for i, pair in enumerate(zip(ids, ids[1:])):
                found = merges.get(pair)
                if found is not None and (best is None or found[0] < best[0]):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return tuple(ids)

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merges as sorted keys, their ranks and what they make."""
        if not hasattr(self, "_sorted"):
            found = sorted((a * len(self.tokens) + b, rank, whole) for (a, b), (rank, whole) in self.merges.items())
            self._sorted = tuple(np.array(x, dtype=t) for x, t in zip(zip(*found), (np.int64, np.int32, np.int32))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        return self._sorted

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (none: ``_NEVER``) and what it makes."""
        keys, ranks, wholes = self._pairs()
        if not len(keys):
            return np.full(len(left), _NEVER, np.int32), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) * len(self.tokens) + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, ranks[at], _NEVER), wholes[at]

    def merge_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words (bytes and offsets) one after another and how many each has; the same merges, a step of all words at once."""
        size = np.diff(offsets)
        counts = np.zeros(len(size), dtype=np.int64)
        pools: list[np.ndarray] = []
        order: list[np.ndarray] = []
        for low, high in ((0, 12), (12, LONGEST_WORD)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if len(rows):
                ids, n = self._merge_block(data, offsets[rows], size[rows])
                counts[rows] = n
                pools.append(ids)
                order.append(rows)
        for row in np.flatnonzero(size > LONGEST_WORD):
            ids = np.array(self.merge(data[offsets[row] : offsets[row + 1]].tobytes()), dtype=np.int32)
            counts[row] = len(ids)
            pools.append(ids)
            order.append(np.array([row]))
        if not pools:
            return np.zeros(0, np.int32), counts
        rows = np.concatenate(order)
        starts = np.zeros(len(size), dtype=np.int64)
        starts[rows] = np.cumsum(counts[rows]) - counts[rows]
        return transducer.gather(np.concatenate(pools), starts, counts), counts

    def _merge_block(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(size), int(size.max())
        column = np.arange(width)
        there = column < size[:, None]
        row_of, col_of = np.nonzero(there)
        ids = np.full((n, width), -1, dtype=np.int32)
        ids[row_of, col_of] = np.array(self.inner, dtype=np.int32)[data[starts[row_of] + col_of]]
        every = np.arange(n)
        ids[every, size - 1] = np.array(self.last, dtype=np.int32)[data[starts + size - 1]]
        after = np.where(column + 1 < size[:, None], column + 1, width).astype(np.int32)
        before = np.broadcast_to((column - 1).astype(np.int32), (n, width)).copy()
        rank = np.full((n, width), _NEVER, dtype=np.int32)
        whole = np.zeros((n, width), dtype=np.int32)
        paired = col_of + 1 < size[row_of]
        r, c = row_of[paired], col_of[paired]
        rank[r, c], whole[r, c] = self._rank(ids[r, c], ids[r, c + 1])
        rows = every
        while len(rows):
            at = rank[rows].argmin(axis=1)  # the leftmost of the lowest rank
            on = rank[rows, at] < _NEVER
            rows, at = rows[on], at[on]
            gone = after[rows, at]
            ids[rows, at], ids[rows, gone], rank[rows, gone] = whole[rows, at], -1, _NEVER
            right = after[rows, gone]
            after[rows, at], rank[rows, at] = right, _NEVER
            on = right < width
            r, c, d = rows[on], at[on], right[on]
            before[r, d] = c
            rank[r, c], whole[r, c] = self._rank(ids[r, c], ids[r, d])
            left = before[rows, at]
            on = left >= 0
            r, c, d = rows[on], left[on], at[on]
            rank[r, c], whole[r, c] = self._rank(ids[r, c], ids[r, d])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same through a heap of pairs and links between neighbours."""
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found[0], i, ids[i], ids[i + 1], found[1]) for i in range(n - 1) if (found := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(waiting)

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n and (found := merges.get((ids[i], ids[after[i]]))):
                heapq.heappush(waiting, (found[0], i, ids[i], ids[after[i]], found[1]))

        while waiting:
            _, i, a, b, whole = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return tuple(x for x in ids if x >= 0)


class Cutter:
    """Words of texts, as the tokenizers library normalises and splits them.

    Text of the first 0x300 characters has no marks to compose and is lower-cased and split here; other text goes through the
    library's normaliser and ``regex``, and is split by the library itself if it has a character that the two class differently.
    """

    def __init__(self, rules: Rules):
        from tokenizers import Tokenizer

        empty = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        library = Tokenizer.from_str(json.dumps(empty | rules.cut))
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        pattern = rules.cut["pre_tokenizer"]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.plain = None
        if "\\" not in re.sub(r"\[[^\]]*\]", "", pattern):  # classes of characters only inside brackets
            for name in (r"\p{L}", r"\p{N}", r"\s"):
                of = regex.compile(name)
                pattern = pattern.replace(name, "".join(f"\\u{i:04x}" for i in range(0x300) if of.match(chr(i))))
            if not re.search(r"\\[^u]", pattern):
                self.plain = re.compile(pattern).findall
        self.beyond = re.compile("[^\x00-\u02ff]").search
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(rules.specials, key=len, reverse=True))) + ")") if rules.specials else None
        self.agreed = set(map(chr, range(128)))

    def words(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if self.plain is not None and (text.isascii() or not self.beyond(text)):
            return self.plain(text.lower())
        text = self.normalise(text)
        unsure = set(text) - self.agreed
        if unsure:
            same = {c for c in unsure if self.find(p := f"a{c}a{c}{c}1{c}!{c}") == [w for w, _ in self.split(p)]}
            self.agreed |= same
            if len(same) < len(unsure):
                return [w for w, _ in self.split(text)]
        return self.find(text)


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """The text cut before ASCII white space into pieces of ``most`` characters or the next gap beyond."""
    at, n = 0, len(text)
    gap = regex.compile(r"[\x09-\x0D\x20]")
    while n - at > most:
        found = gap.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of about ``PIECE`` characters of text (one row at least) with their texts."""
    for batch in batches:
        at, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(batch.column(column)[i].as_py() or "")
            size += len(texts[-1])
            if size >= PIECE or i == batch.num_rows - 1:
                yield batch.slice(at, i + 1 - at), texts
                at, size, texts = i + 1, 0, []


def _numbered(words: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct ones, and those."""
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _buffers(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), offsets


class Encoder:
    """Encodes lists of texts."""

    def __init__(self, rules: Rules, lexicon: transducer.Transducer):
        self.rules, self.lexicon, self.cutter = rules, lexicon, Cutter(rules)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        codes, distinct = _numbered(words)
        known, counts, pool = self.lexicon.walk(*_buffers(distinct))
        starts = np.cumsum(counts) - counts
        special = {at.as_py(): i for at, i in zip(pc.index_in(pa.array(list(self.rules.specials), distinct.type), value_set=distinct), self.rules.specials.values()) if at.is_valid}
        for at, i in special.items():  # a cut word never looks like one: its signs and letters are apart
            known[at], counts[at], starts[at] = True, 1, len(pool)
            pool = np.append(pool, np.int32(i))
        rest = np.flatnonzero(~known)
        merged, n = self.rules.merge_all(*_buffers(distinct.take(pa.array(rest))))
        counts[rest] = n
        starts[rest] = len(pool) + np.cumsum(n) - n
        return transducer.gather(np.concatenate([pool, merged]), starts[codes], counts[codes]).astype(np.int32), counts[codes]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's ids begin (with the end of the last)."""
        ids, sizes = [], []
        words: list[str] = []
        ends: list[int] = []

        def flush() -> None:
            found, counts = self._ids(words)
            upto = np.concatenate([[0], np.cumsum(counts)])
            bounds = upto[np.array([0, *ends])]
            ids.append(found)
            sizes.extend(np.diff(bounds).tolist())
            words.clear()
            ends.clear()

        for text in texts:
            if len(text) > PIECE:
                flush()
                total = 0
                for part in pieces(text):
                    found, _ = self._ids(self.cutter.words(part))
                    ids.append(found)
                    total += len(found)
                sizes.append(total)
            else:
                words += self.cutter.words(text)
                ends.append(len(words))
        flush()
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.array(sizes, dtype=np.int64))])


def decode_ids(rules: Rules, ids: list[int]) -> bytes:
    """Tokens joined by one space (the file names no decoder), UTF-8; ids that the file does not have are left out."""
    tokens = rules.tokens
    try:
        return b" ".join([tokens[i] for i in ids])
    except (TypeError, IndexError):
        return b" ".join([tokens[i] for i in ids if 0 <= i < len(tokens) and tokens[i] is not None])


def count_words(docs: DataFrame, rules: Rules) -> DataFrame:
    """word and n: occurrences of every word in all documents (special tokens are no words)."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)  # of one tokenizer file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(shared.value)
        for _, texts in _groups(batches, 0):
            short = (w for t in texts if len(t) <= PIECE for w in cutter.words(t))
            long = (cutter.words(p) for t in texts if len(t) > PIECE for p in pieces(t))
            for words in chain([list(short)], long):
                if words:
                    codes, distinct = _numbered(words)
                    n = pa.array(np.bincount(codes, minlength=len(distinct)))
                    yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), n], ["word", "n"])

    counted = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(~F.col("word").isin(list(rules.specials))) if rules.specials else counted


def frequent_words(counted: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """The most frequent words, ``most`` at the most: all those from some count on (counts of over 32 are compared by their first five bits)."""
    short = reliable(counted.filter(F.octet_length("word") <= LONGEST_WORD))
    level = F.expr("shiftleft(shiftright(n, greatest(length(bin(n)) - 5, 0)), greatest(length(bin(n)) - 5, 0))")
    steps = short.groupBy(level.alias("level")).count().collect()  # at most 16 levels for each binary digit of a count
    line, total = None, 0
    for row in sorted(steps, reverse=True):
        total += row["count"]
        if total > most:
            break
        line = row["level"]
    return short.filter(F.lit(False)) if line is None else short.filter(F.col("n") >= F.lit(line))


def _store(spark: SparkSession, data: bytes, path: str) -> None:
    """Write a file through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    out.write(data)
    out.close()


def fit(docs: DataFrame, tokenizer_file: str, path: str | None = None, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of the documents' frequent words; returns the path of its file (in the shared folder unless named).

    The file holds at most ``most`` words and stays where it is: frames made with it need it as long as they are used.
    """
    spark = docs.sparkSession
    rules = Rules(read_spec(tokenizer_file))
    chosen = frequent_words(count_words(docs, rules), most).select("word").toArrow().column("word").to_pylist()
    words = sorted(w.encode() for w in chosen)
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lexicon-{uuid.uuid4().hex}.bin"
    _store(spark, transducer.build((w, rules.merge(w)) for w in words), path)
    return path


def encode(docs: DataFrame, tokenizer_file: str, lexicon: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids and (if asked for) the decoded text of every row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Rules(read_spec(tokenizer_file)))  # of one tokenizer file
    spark.sparkContext.addFile(lexicon)
    name = lexicon.rstrip("/").rpartition("/")[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = shared.value
        encoder = Encoder(rules, transducer.Transducer(SparkFiles.get(name)))
        for rows, texts in _groups(batches, 1):
            ids, starts = encoder.encode(texts)
            columns = [rows.column(0), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))]
            if decoded:
                every = ids.tolist()
                columns.append(pa.array([decode_ids(rules, every[a:b]) for a, b in zip(starts.tolist(), starts[1:].tolist())], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id and the decoded text of rows that hold ids; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Rules(read_spec(tokenizer_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_ids(shared.value, x.as_py() or []) for x in batch.column(1)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")
