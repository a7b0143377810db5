"""Transducer BPE, target draw and divergence audit: against the library or brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.test_text_operators import DOCS, docs_of, empty_docs, odd_docs
from wattpanel.llm import bpe, common, divergence, queries, target_draw, transducer

FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
HARD = [
    "Hello <|startoftext|>World's<|endoftext|><|StartOfText|> I'LL we've 123",
    "ΑΣ ΣΑΣ. İstanbul ǅ ﬁ Å Å é é q̣̇ ́x",
    "a\x1cb\x85c d e​f᠎g　h",
    "中文字 日本語テキスト 한국어 😀👍🏽 ½ Ⅷ ²",
    "\U00010d50x Ɤ ՘ \U0003d000z unknown to older tables",
    "'s'S 'Tis ''s don't!!!...<|end",
    "x" * 700 + " " + "ab" * 900 + "é" * 400,
    "\x00\x01 \t\r\n",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def encoded(spark, docs, most=bpe.LEXICON_WORDS):
    return bpe.encode(docs, FILE, bpe.fit(docs, FILE, most=most), decoded=True)


# --- transducer


def test_transducer_gives_every_word_its_output_and_knows_no_other(tmp_path):
    rng = random.Random(5)
    words = sorted({bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(3_000)})
    out = {w: tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4))) for w in words}
    path = tmp_path / "t.bin"
    path.write_bytes(transducer.build(out.items()))
    found = transducer.Transducer(str(path))
    asked = words + [w + b"z" for w in words[:50]] + [b"", b"abcabcabcabcabc"]
    data = np.frombuffer(b"".join(asked), np.uint8)
    known, counts, ids = found.walk(data, np.concatenate([[0], np.cumsum([len(w) for w in asked])]))
    assert known.tolist() == [w in out for w in asked]
    at = 0
    for w, n in zip(asked, counts.tolist()):
        assert tuple(ids[at : at + n].tolist()) == out.get(w, ())
        at += n


def test_transducer_shares_endings_and_is_minimal(tmp_path):
    entries = [(a + b, (i, 9)) for i, a in enumerate((b"count", b"paint", b"walk")) for b in (b"ed", b"ing", b"s")]
    path = tmp_path / "t.bin"
    path.write_bytes(transducer.build(sorted(entries)))
    # root; c, co, p, pa, w, wa, wal; cou = pai, coun = pain; the end of a stem; e, i, in and the end of a word
    assert transducer.Transducer(str(path)).states == 1 + 7 + 2 + 1 + 4
    with pytest.raises(ValueError):
        transducer.build([(b"b", (1,)), (b"a", (2,))])


# --- BPE


def test_encoding_equals_the_library(spark, tokenizer):
    rng = random.Random(3)
    alphabet = "aB é́'!1ßΣσ中̇ \n" + "<|>"
    texts = HARD + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 0x24F), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(40)) for _ in range(200)]
    for most in (0, 20, bpe.LEXICON_WORDS):
        for row in encoded(spark, docs_of(spark, texts), most).collect():
            want = tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids
            assert row.ids == want
            assert row.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_long_texts_are_cut_without_a_trace(spark, tokenizer, monkeypatch):
    long = "Alpha beta's <|endoftext|> gamma-9 délta\n" * 40_000
    want = tokenizer.encode(long, add_special_tokens=False).ids
    row = encoded(spark, docs_of(spark, [long])).first()
    assert row.ids == want and row.decoded == tokenizer.decode(want, skip_special_tokens=False)
    assert list(bpe.pieces("ab cd efgh ij", 3)) == ["ab cd"[:5], " efgh", " ij"]


def test_encoding_odd_rows(spark, tokenizer):
    rows = encoded(spark, odd_docs(spark)).collect()
    texts = {r.doc_id: r.text for r in odd_docs(spark).filter("doc_id is not null").collect()}
    assert len(rows) == odd_docs(spark).count()
    for row in rows:
        if row.doc_id is not None:
            assert row.ids == tokenizer.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
    assert encoded(spark, empty_docs(spark)).collect() == []


def test_decode_leaves_out_unknown_ids(spark, tokenizer):
    frame = spark.createDataFrame([(1, [3306, 49_999, 1002, -5]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(frame, FILE).collect()}
    assert got == {1: tokenizer.decode([3306, 1002], skip_special_tokens=False), 2: "", 3: ""}


def test_lexicon_holds_the_most_frequent_words(spark):
    counted = spark.createDataFrame([("a", 9), ("b", 9), ("c", 5), ("d", 1), ("e" * 65, 99)], "word string, n long")
    pick = lambda most: sorted(r.word for r in bpe.frequent_words(counted, most).collect())
    assert [pick(m) for m in (0, 1, 2, 3, 9)] == [[], [], ["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]


def test_other_kinds_of_tokenizer_are_refused():
    with pytest.raises(ValueError):
        bpe.read_spec(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_query_equals_the_library(spark, tokenizer):
    texts = {r.doc_id: r.text or "" for r in common.read(spark, SF, "documents").collect()}
    rows = queries.op11_transducer_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- target draw


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_draw(docs, target, percent=10, shortest=1, longest=1):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]

    corpus, wanted = (Counter(b for x in rows for b in grams(x)[1]) for rows in ([t for _, t in docs], target))
    s_all, t_all = float(sum(corpus.values())), float(sum(wanted.values()))
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000)))) for b in corpus}
    out = []
    for i, t in docs:
        words, found = grams(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_draw_equals_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(target_draw, "PIECE", 150)  # texts are cut into many pieces
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Été", "É", "x-y", "a_b", "中文"]
    docs = [(i % 190, " ".join(rng.choices(words, k=rng.randint(0, 80)))) for i in range(200)] + [(None, "Null id " * 30), (500, None), (501, "")]
    target = [" ".join(rng.choices(words[:20], k=50)) for _ in range(5)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = target_draw.draw(frame, spark.createDataFrame([(t,) for t in target], "text string"), 10, *sizes)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)
    # pieces of another size do not change what brute force finds over whole texts
    assert got == plain_draw(docs, target, 10, *sizes)


def test_draw_odd_rows(spark):
    target = spark.createDataFrame([("alpha beta",)], "text string")
    rows = target_draw.draw(odd_docs(spark), target).collect()
    assert len(rows) == odd_docs(spark).count()
    assert all(r.weight == 0 and r.n_features == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert target_draw.draw(empty_docs(spark), target).collect() == []
    assert target_draw.draw(odd_docs(spark), target.limit(0), percent=100).filter("rank is not null").count() == odd_docs(spark).count() - rows_short(spark)


def rows_short(spark):
    return sum(len(re.findall(target_draw.WORD, r.text or "")) < 20 for r in odd_docs(spark).collect())


# --- divergence


def plain_audit(rows, min_docs, top):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        counts[lang or "", source or ""].update(terms)
        groups.add((lang or "", source or ""))
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = {t for t, n in in_docs[lang].items() if n >= min_docs}
        mine = {s: counts[lang, s] for x, s in groups if x == lang}

        def priced(count):
            below = sum(count[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 5) // below for t in kept}

        whole = priced(sum(mine.values(), Counter()))
        price = {s: priced(c) for s, c in mine.items()}
        for s in mine:
            pairs = [(sum(abs(price[s][t] - price[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(price[s][t] - whole[t], t) for t in kept if mine[s][t] and price[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(8_192, 8), (7, 2), (1, 1)])
def test_audit_equals_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "PIECE", 300)
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdÉé" for b in "xyzäÄ\U0001f600"] + ["UP", "up", "１"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", "￮", "\U00010000", None]), " ".join(rng.choices(words[: rng.randint(3, len(words))], k=rng.randint(0, 90)))) for _ in range(250)]
    rows += [("fr", "alone", "une"), ("xx", "a", None), ("xx", "b", "1 2 3"), ("xx", "c", "rare")]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.audit(frame, 5, 12).collect())
    assert got == plain_audit(rows, 5, 12)


def test_gallop_equals_bisection():
    rng = np.random.default_rng(2)
    for m, n in [(0, 0), (0, 5), (5, 0), (1, 1), (3, 1000), (100, 1000), (1000, 100), (257, 4096)]:
        needles, ids = (np.unique(rng.integers(0, 5_000, k)) for k in (m, n))
        assert divergence.gallop(needles, ids).tolist() == np.searchsorted(ids, needles).tolist()


def test_prices_are_exact_for_large_counts():
    counts = np.array([0, 7, 10**10, 9 * 10**17], dtype=np.int64)
    total = int(counts.sum())
    assert divergence.prices(counts, total, 4).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 20) for c in counts]


def test_column_price_is_exact(spark):
    row = spark.createDataFrame([(10**16, 3 * 10**16 + 1, 4)], "n long, total long, kept long").select(divergence._price(F.col("n"), F.col("total"), F.col("kept"))).first()
    assert row[0] == 1 + 10**9 * (10**16 + 5) // (3 * 10**16 + 21)


def test_audit_odd_rows(spark):
    got = divergence.audit(odd_docs(spark), 1).collect()
    want = plain_audit([(r.lang, r.source, r.text) for r in odd_docs(spark).collect()], 1, 50)
    assert sorted(tuple(r) for r in got) == want
    assert divergence.audit(empty_docs(spark)).collect() == []
    assert docs_of(spark, ["a"]).schema.simpleString() == spark.createDataFrame([], DOCS).schema.simpleString()
