"""The text operators against brute force on small fixtures, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wattpanel.llm import common, decontam, html_blocks, importance, langmix, license_scan, mixing, quality_rules, quotes, secret_scan, simhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, sources=None, langs=None):
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "a", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=None):
    words = words or [a + b for a in ("lor", "ip", "dol", "sit", "am", "con", "sec", "tur", "ed", "mag") for b in ("em", "um", "or", "is", "et", "a", "que", "it")]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and extra columns whose names clash."""
    long_text = "alpha beta gamma " * 40_000 + "x" * 3_000_000
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 5),
        (2, "one two three four five six seven eight nine ten eleven", "en", "b", None),
        (None, "null id text with some words in it for the sake of it", None, None, 3),
        (None, None, None, None, None),
        (3, None, "en", "a", 0),
        (4, "", "de", None, 0),
        (5, " \t\n ", "de", "", 4),
        (6, long_text, "fr", "a", len(long_text)),
        (7, "é ü ñ 中文 😀", "fr", "c", 9),
    ]
    clash = ["_k1", "_k2", "_id", "_none", "_row", "_key", "size", "whole", "extra", "shards", "kept", "key", "fp", "comp", "hw", "at", "seed", "w", "block", "rank", "score", "lead", "pieces", "_masked"]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


# --- word hashes


def test_word_hashes_tell_words_apart_and_count_them():
    rng = random.Random(1)
    texts = [None, "", "  ", "one", " a  b\tc\n", "é ü " * 50, "y" * 2_500_000 + " tail", prose(rng, 400_000), "last one"]
    hashes, rows = common.word_hashes(pa.array(texts, pa.string()))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert np.diff(rows).tolist() == [len(w) for w in words]
    seen = defaultdict(set)
    for h, w in zip(hashes.tolist(), (x for ws in words for x in ws)):
        seen[w].add(h)
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


# --- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_golay_keys_meet_at_one_bit():
    words = np.random.default_rng(3).integers(0, 1 << 23, 3000)
    _, whole = simhash.golay_keys(words)
    for bit in range(23):
        nearest, _ = simhash.golay_keys(words ^ (1 << bit))
        assert (whole == nearest[:, None]).any(axis=1).all()


def near_texts(rng):
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(60)] + ["", None, "Single", "single"]
    for base in [prose(rng, 150) for _ in range(4)]:
        texts.append(base)
        for _ in range(12):
            words = base.split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates_equal_brute_force(spark):
    texts = near_texts(random.Random(5))
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    assert [got[i]["fp"] & (2**64 - 1) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs_of(spark, texts)).collect())
    assert kept == sorted({find(i) for i in range(len(texts))})


def test_link_finds_all_pairs_of_three_bits(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:150]:
        for _ in range(rng.randint(1, 3)):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.append(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {r["fp"]: r["comp"] for r in simhash.link(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    groups = {f: {f} for f in signed}
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3 and groups[a] is not groups[b]:
                joined = groups[a] | groups[b]
                for x in joined:
                    groups[x] = joined
    assert got == {f: min(groups[f]) for f in signed}


# --- decontamination


def test_decontamination_finds_substituted_passages_only(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (15, 25, 60)] + ["too short", None, ""]
    clean = [prose(rng, 200) for _ in range(10)]
    exact = [prose(rng, 40) + " " + items[i] + ", " + prose(rng, 30) for i in (0, 1, 2)]
    changed = []
    for i in (0, 1, 2):
        words = items[i].split()
        for at in range(6, len(words), 13):
            words[at] = "changed"
        changed.append("start of it " + " ".join(words).upper() + " end")
    part = [prose(rng, 20) + " " + " ".join(items[2].split()[20:40]) + " " + prose(rng, 20)]
    docs = docs_of(spark, clean + exact + changed + part + [None, "", items[0]])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.overlaps(docs, bench).collect()}
    assert set(got) == {(10, 0), (11, 1), (12, 2), (13, 0), (14, 1), (15, 2), (16, 2), (19, 0)}
    assert got[10, 0]["first_word"] == 40 and got[10, 0]["overlap"] == 1.0
    blocks = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, bench, block_rows=60).collect()}
    assert blocks == set(got)
    assert sorted(r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()) == [*range(10), 17, 18]


# --- secrets


def test_secret_scan_base_spans_random_tokens_and_masking(spark):
    rng = random.Random(4)
    token = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [
        'é password = "abcd1234" and API_KEY:ZZZZZZZZ9, token=short',
        "AKIAABCDEFGH1234 AKIA12 deadbeefdeadbeefdeadbeefdeadbeef00",
        f"see {token} here",
        "plain words and averyveryverylongordinarywordinlowercase 4785380592391139",
        "a" * 20 + "1" * 20,
        "ſecret = abcdefgh1 paſſword: 12345678",
        None,
        "",
        "token = token=abcdefgh12",
    ]
    got = {r["doc_id"]: r for r in secret_scan.scan(docs_of(spark, texts + [f"x{i}" + "ab" * 14 for i in range(40)])).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        want = []
        for kind, order, pattern, least, group in (
            ("assign", 0, r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
            ("access", 1, r"AKIA[A-Z0-9]+", 16, 0),
            ("hex", 2, r"[0-9a-f]+", 32, 0),
        ):
            want += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t, re.ASCII) if len(m[group]) >= least]
        base = ",".join(x for *_, x in sorted(want))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert got[i]["n_assign"] + got[i]["n_access"] + got[i]["n_hex"] == len(want)
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")] == [x for *_, x in sorted(want)]
    assert got[2]["n_random"] == 1 and got[2]["spans"] == "random_base62:4:44"
    assert got[3]["n_random"] == 0 and got[4]["n_random"] == 0
    masked = {r["doc_id"]: r for r in secret_scan.redact(docs_of(spark, texts)).collect()}
    assert masked[3]["text"] == texts[3] and masked[6]["text"] is None
    assert masked[1]["text"] == "[SECRET] AKIA12 [SECRET]" and masked[1]["n_chars"] == len(masked[1]["text"])


def test_battery_separates_random_from_ordinary():
    rng = random.Random(6)
    alphabet = secret_scan.ENCODINGS[2][2]
    rejected = sum(min(secret_scan.battery([rng.randrange(62) for _ in range(40)], 62)) < 0.001 for _ in range(500))
    assert rejected < 25
    assert min(secret_scan.battery([alphabet.index(c) for c in "internationalisationofordinarywords12345"], 62)) < 0.001


# --- HTML


def test_main_text_rules():
    body = "The quick brown fox is in the garden and it was not at all afraid of the dog that lay by the door of the house. " * 2
    body = body.strip()
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href='/x>y'>More</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site and the law asks us to tell you that it is so and that you agree to it.</div>
    <article><h1>Title  here</h1><p>{body}<br><p>Short &lt;one&gt; &amp; &#233;.</p><p><b>Bold</b> <a href="#">link</a> in the text of it, and then the words go on and on for a while in the same way.
    <div class="ad">Buy the thing that is the best of all the things in the shop and in the town at the moment.</div>
    <aside>On the side</aside><form>Name <input> the form is for the name of you and it is not of the text at all, so there.</form><p>End &am</p>
    <section id="comments"><p>{body}</p></section></article><div id=sidebar>{body}</div><footer>&copy; 2020 {body}</footer></body></html>"""
    want = [
        "Title here",
        body,
        "Short <one> & é.",
        "Bold link in the text of it, and then the words go on and on for a while in the same way.",
        "End &am",
    ]
    assert html_blocks.main_text(page).split("\n\n") == want
    plain = f"<body><div>Home | About</div><p>{body}</p><p>Then short.</p><p>{body}</p><div>Imprint</div><ul><li><a href=1>a b c</a></li></ul>"
    assert html_blocks.main_text(plain).split("\n\n") == [body, "Then short.", body]
    for bad in (None, "", "<", "<p", "a < b", "<!-- x", "<script>x", "</", "<p>" * 3000, "<div>" * 3000 + "x"):
        html_blocks.main_text(bad)
    assert html_blocks.main_text("<article>x<p>y") == "x\n\ny"


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>A b</p></article>"), (1, "u", "<article><p>A b</p></article>"), (None, None, None)]
    got = html_blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in got) == [(0, "", "", 0), (1, "u", "A b", 3), (1, "u", "A b", 3)]
    assert html_blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- quotations


def test_quotation_threads(spark):
    rows = [
        (1, 0, "user", "How do I open\nthe big door?\n\nAnd the window?"),
        (1, 1, "user", "Another topic here."),
        (1, 2, "assistant", "On Monday, Ann wrote:\n> How do I open the\n> big DOOR?\n\nUse the key."),
        (1, 3, "assistant", "> Another topic here.\nI see."),
        (1, 4, "user", "> > How do I open the big door?\n> Use the key.\n\nThanks!"),
        (1, 4, "user", "> > How do I open the big door?\n> Use the key.\n\nThanks!"),
        (1, 5, "user", "> Never said by anyone\nHm."),
        (2, 0, "user", "Use the key."),
        (2, 1, "user", "> Use the key.\nYes"),
        (None, 1, "user", "x y"),
        (None, 2, "user", "> x y"),
        (3, None, None, None),
        (3, None, "user", "> x y"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("root", F.lit(2))
    got = sorted(((r["conv_id"], r["turn"]), r["parent_turn"], r["root_turn"], r["depth"], r["n_quotes"], r["text"]) for r in quotes.link(frame).filter("conv_id = 1").collect())
    assert [x[:5] for x in got] == [
        ((1, 0), None, 0, 0, 0),
        ((1, 1), None, 1, 0, 0),
        ((1, 2), 0, 0, 1, 1),
        ((1, 3), 1, 1, 1, 1),
        ((1, 4), 2, 0, 2, 2),
        ((1, 4), 2, 0, 2, 2),
        ((1, 5), None, 5, 0, 1),
    ]
    assert got[2][5] == "Use the key." and got[4][5] == "Thanks!"
    rest = {(r["conv_id"], r["turn"], r["parent_turn"]) for r in quotes.link(frame).filter("conv_id is null or conv_id > 1").collect()}
    assert rest == {(2, 0, None), (2, 1, 0), (None, 1, None), (None, 2, 1), (3, None, None)}
    assert quotes.link(frame.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(9, i, "user", (f"> body number {i - 1}\n" if i else "") + f"body number {i}") for i in range(40)]
    got = {r["turn"]: (r["parent_turn"], r["root_turn"], r["depth"]) for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (i - 1 if i else None, 0, i) for i in range(40)}


# --- languages


def test_language_held_out_accuracy_and_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langmix.fold() == 2
    labelled = docs.filter(F.col("lang").isNotNull() & ~held)
    joined = langmix.identify(docs, labelled).join(docs.select("doc_id", "lang"), "doc_id").filter(held)
    right, n = joined.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.97
    pick = {r["lang"]: r["text"] for r in docs.filter("length(text) between 2000 and 6000").orderBy("doc_id").limit(300).collect()}
    mixed = docs_of(spark, [pick["en"][:1500] + " " + pick["de"][:700], pick["fr"], None, "", "123 !!", "x"])
    got = {r["doc_id"]: r for r in langmix.identify(mixed, labelled).collect()}
    assert got[0]["lang_pred"] == "en" and re.fullmatch(r"en:0\.\d+,de:0\.\d+", got[0]["languages"])
    share = float(got[0]["languages"].split(",")[1].split(":")[1])
    assert 0.2 < share < 0.45
    assert got[1]["lang_pred"] == "fr" and got[1]["languages"] == "fr:1.000"
    assert [got[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and all(got[i]["score"] == 0 for i in (2, 3, 4))
    assert got[5]["lang_pred"] in ("en", "de", "fr", "es") and 0 <= got[5]["score"] <= 1
    assert not langmix._has_letter("² ½ 12_") and langmix._has_letter("² a") and langmix._has_letter("é")
    nothing = langmix.identify(mixed, labelled.limit(0)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# --- quality rules


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n ", "a b c d", "a b c d e", "a a a a a a a", "é# |ü\x0b<😀>", "x y z\nx y z\n \nx y z\n", "a b c d e " * 30, *[prose(rng, rng.randint(1, 300), ["a", "b", "c"]) for _ in range(30)]]
    texts += [prose(rng, 50) + "\n" + prose(rng, 20) for _ in range(10)]
    got = {r["doc_id"]: r for r in quality_rules.judged(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, lines, repeats = plain_measures(t)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats), t
        assert r["base_failed"] == (n < 10 or 100 * repeats > 20 * n)
        assert not (r["base_failed"] and r["kept"])


def test_thresholds_adapt_to_their_group(spark):
    rng = random.Random(7)
    code = ["# " + prose(rng, 4) + " | " + prose(rng, 4) + " & " + prose(rng, 4) for _ in range(220)]
    text = [prose(rng, 40) for _ in range(220)]
    junk = [" ".join(w + "###" for w in prose(rng, 40).split())] * 5
    docs = docs_of(spark, code + text + junk, sources=["code"] * 220 + ["text"] * 225)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs).collect()}
    assert sum(got[i] for i in range(220)) > 200  # usual there
    assert sum(got[i] for i in range(220, 440)) > 210
    assert not any(got[i] for i in range(440, 445))


def test_sketches_merge(spark):
    a = spark.createDataFrame([("en", "a", "length", 5, 3), ("en", "a", "length", 9, 1)], "lang string, source string, measure string, bucket long, n long")
    b = spark.createDataFrame([("en", "b", "length", 5, 1), ("en", "b", "length", 40, 3)], a.schema)
    r = quality_rules._quartiles(a.unionByName(b), ["lang"]).first()
    assert (r["docs"], r["q1"], r["q2"], r["q3"]) == (8, 5, 5, 40)


# --- mixing


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    free, left = set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        add = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s, x in add.items():
            target[s] += x
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                free.discard(s)
    return target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing_targets_and_quotas(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", None, "", "tiny", "zero"]
    sources = [rng.choices(names, [30, 10, 8, 5, 3, 0, 0])[0] for _ in range(300)] + ["tiny", "zero"]
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(300)] + ["one two", ""]
    docs = docs_of(spark, texts, sources)
    rows = mixing.plan(docs, shards=8).collect()
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(t.split())
    target = plain_targets(sizes)
    taken = Counter()
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["shards"] or []) >= r["whole"] + (r["extra"] > 0) or r["size"] == 0
        taken[r["source"]] += r["taken"]
    assert len(rows) == len(texts) and all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    mixed = mixing.mix(docs, shards=8).collect()
    assert Counter((r["doc_id"], r["mix_copy"], r["mix_words"], r["mix_shard"]) for r in mixed) == Counter((r["doc_id"], r["mix_copy"], r["mix_words"], r["mix_shard"]) for r in mixing.mix(docs, shards=8).collect())
    got = Counter()
    for r in mixed:
        assert len((r["text"] or "").split()) == r["mix_words"] and texts[r["doc_id"]].startswith(r["text"])
        got[r["doc_id"]] += r["mix_words"]
    assert got == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_splitting_tree_is_exact_and_hypergeometric(spark):
    quotas = {0: 4000, 1: 3, 2: 0, 3: 9000, 4: 700}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "rank long, quota long"), 16).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in leaves:
        by_rank[r["rank"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
        assert r["quota"] >= 0
        n = sum(quotas.values()) / 16
        p = quotas[r["rank"]] / sum(quotas.values())
        assert abs(r["quota"] - n * p) <= 6 * (n * p * (1 - p)) ** 0.5 + 1
    assert all(by_rank[k] == v for k, v in quotas.items()) and max(by_shard.values()) - min(by_shard.values()) <= 4
    draw = mixing._hypergeometric("60L", "25L", "20L", "u")
    seen = Counter(r[0] for r in spark.range(4000).selectExpr("(id + 0.5D) / 4000 as u").selectExpr(f"{draw} as k").collect())
    from math import comb

    for k in range(21):
        assert abs(seen[k] / 4000 - comb(25, k) * comb(35, 20 - k) / comb(60, 20)) < 0.001


# --- licenses


def test_license_places_and_labels(spark):
    texts = [
        "Text. Licensed under the Apache License, Version 2.0. More APACHE-license!",
        "This work is licensed under the GNU General Public License, version 3.",
        "cc-by cc by",
        "Licensed under CC BY-NC 4.0.",
        "an apache licensee; mit  license; amit license",
        "This program is free software: you can redistribute it and/or change and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, say",
        "no license here",
        None,
        "",
        "cc",
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places, labels = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            at = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(places, default=None), max(places, default=None)), t
        assert r["base_labels"] == ",".join(sorted(labels)) and 0 <= r["score"] <= 1
        assert labels <= set(r["labels"].split(","))
    assert got[0]["labels"] == "apache,apache-2.0" and got[1]["labels"] == "gpl,gpl-3.0" and got[3]["labels"] == "cc-by,cc-by-nc-4.0"
    assert got[5]["labels"] == "gpl" and 0.8 <= got[5]["score"] <= 1  # two words more: neighbouring diagonals
    assert got[6]["labels"] == "" and got[6]["score"] < 0.8


# --- importance resampling


def test_top_k_equals_sort(spark):
    rng = random.Random(1)
    rows = [(i if i % 7 else None, i % 5, i % 3, 0.0, rng.choice([1.5, 1.5, rng.gauss(0, 50), 1.5000001])) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, _k1 long, _k2 long, log_weight double, key double")
    order = sorted(-r[4] for r in rows)
    for k in (0, 1, 57, 200, 399, 400, 1000):
        kept = importance.top_k(frame, k).filter("kept").collect()
        line = order[min(k, 400) - 1] if k else None
        assert len(kept) >= min(k, 400) and len(kept) - min(k, 400) < 30
        assert all(-r["key"] <= line for r in kept)
    distinct = frame.withColumn("key", F.col("key") + F.monotonically_increasing_id() * 1e-9)
    assert importance.top_k(distinct, 123).filter("kept").count() == 123


def test_importance_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(9)
    good = [prose(rng, rng.randint(30, 200)) for _ in range(300)]
    junk = [prose(rng, rng.randint(30, 200), ["spam", "buy", "now", "###", "win"]) for _ in range(60)]
    mixed = [g + " " + j for g, j in zip(good[:20], junk)]
    docs = docs_of(spark, good + junk + mixed + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 360, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in importance.resample(docs, labels).collect()}
    assert sum(got[i] for i in range(300)) > 285
    assert sum(got[i] for i in range(300, 360)) == 0 and sum(got[i] for i in range(360, 380)) == 0  # one bad passage is enough
    assert got == {r["doc_id"]: r["kept"] for r in importance.resample(docs, labels).collect()}
    assert importance.select(docs, labels).count() == sum(got.values())
    assert importance.resample(docs, labels, k=100).filter("kept").count() == 100
    assert importance.select(docs, labels.limit(0)).count() == docs.count()


# --- odd input


def test_odd_rows(spark):
    docs, n = odd_docs(spark), 10
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (3, None, None), (None, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int").withColumn("kept", F.lit(1))
    bench = spark.createDataFrame([(None, "one two three four five six seven eight nine ten eleven"), (1, None), (1, None)], "item_id long, text string").withColumn("hw", F.lit(1))
    assert importance.resample(docs, labels).count() == n
    assert importance.select(docs, labels).columns == docs.columns
    assert {r["doc_id"] for r in decontam.overlaps(docs, bench).collect()} == {1, 2}
    left = decontam.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == n - 3
    assert secret_scan.scan(docs).count() == n
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and masked.count() == n
    assert langmix.identify(docs, docs.filter("lang is not null")).count() == n
    assert quality_rules.judged(docs).count() == n
    assert mixing.plan(docs).count() == n
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_copy", "mix_words", "mix_order"]
    assert mixed.agg(F.sum("mix_words")).first()[0] == mixing.plan(docs).agg(F.sum("taken")).first()[0]
    assert simhash.near_duplicates(docs).count() == n
    one = simhash.deduplicate(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in one.collect()) == [0, 1, 3, 6, 7]  # words of 1 and 2 agree; 3, 4, 5 and the null text have none
    assert license_scan.scan(docs).count() == n


def test_empty_tables(spark):
    docs = empty_docs(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (
        importance.resample(docs, labels),
        importance.select(docs, labels),
        decontam.overlaps(docs, bench),
        decontam.decontaminate(docs, bench),
        secret_scan.scan(docs),
        secret_scan.redact(docs),
        langmix.identify(docs, docs),
        quality_rules.judged(docs),
        mixing.plan(docs),
        mixing.mix(docs),
        simhash.near_duplicates(docs),
        simhash.deduplicate(docs),
        license_scan.scan(docs),
    ):
        assert frame.count() == 0
    some = docs_of(spark, ["one two three"])
    assert decontam.decontaminate(some, bench).count() == 1
