"""Every pattern of changed words that the verification accepts shares a seed with its item."""

from __future__ import annotations

from itertools import combinations

import pytest

from wattpanel.llm import decontam


def hit(masks, length, changed):
    free = [i not in changed for i in range(length)]
    return any(all(free[at + j] for j, c in enumerate(m) if c == "1") for m in masks for at in range(length - len(m) + 1))


@pytest.mark.parametrize("share", [0.8, 0.7, 0.9])
def test_all_patterns_are_hit(share):
    for length in range(1, decontam.WINDOW + 1):
        masks = decontam.masks_for(length, share)
        for k in range(length - decontam.least_equal(length, share) + 1):
            missed = [p for p in combinations(range(length), k) if not hit(masks, length, p)]
            assert not missed, (length, k, len(missed))


def test_short_and_changed_items_are_found(spark):
    items = {n: [f"item{n}word{i}" for i in range(n)] for n in (1, 3, 5, 9, 10, 11, 15, 16)}
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    texts = []
    for n, words in items.items():
        size = min(n, 15)
        for p in combinations(range(size), size - decontam.least_equal(size)):
            if n < 15 or sum(p) % 7 == 0:
                texts.append((n, "before it " + " ".join("changed" if i in p else w for i, w in enumerate(words)) + " after it"))
    docs = spark.createDataFrame([(n * 1000 + i, t) for i, (n, t) in enumerate(texts)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(n * 1000 + i, n) for i, (n, _) in enumerate(texts)}
    assert decontam.overlaps(docs, bench, min_words=10).filter("item_id < 10").isEmpty()
