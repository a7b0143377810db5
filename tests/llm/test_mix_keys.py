"""Rows whose id, source and text run together to one string stay apart in the mix."""

from __future__ import annotations

from collections import Counter

from wattpanel.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_read_alike_get_their_own_shares(spark):
    rows = [(1, "a|b c d", "en", None, 0), (1, "b c d", "en", "a", 0), (1, "c|d e", "en", "-", 0), (2, "2:x|y z", "en", None, 0), (2, "y z", "en", "x", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    planned = {(r["doc_id"], r["source"], r["size"]): r["taken"] for r in mixing.plan(docs, shards=4).collect()}
    mixed = mixing.mix(docs, shards=4).collect()
    words = Counter()
    for r in mixed:
        assert len(r["text"].split()) == r["mix_words"]
        whole = [t for i, t, _, s, _ in rows if (i, s) == (r["doc_id"], r["source"])]
        assert any(t.startswith(r["text"].rstrip()) for t in whole)
        words[r["doc_id"], r["source"]] += r["mix_words"]
    assert len({r["_key"] for r in mixing.plan(docs, shards=4).collect()}) == len(rows)
    assert words == Counter({(i, s): n for (i, s, _), n in planned.items() if n})
