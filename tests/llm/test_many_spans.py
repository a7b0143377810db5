"""Candidates beside many base spans: as by comparing all pairs, and in time that follows the text."""

from __future__ import annotations

import random
import time

from wattpanel.llm import secret_scan


def test_candidates_touch_no_base_span_as_by_all_pairs():
    rng = random.Random(9)
    letters = "abcdefABCDEF0123456789+/_-=zZ"
    for _ in range(60):
        words = ["".join(rng.choices(letters, k=rng.randint(10, 50))) for _ in range(30)]
        words += ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(6)] + [f"token={w}" for w in words[:4]] + ["AKIA" + "X7" * 9]
        rng.shuffle(words)
        text = " ".join(words)
        base = secret_scan.base_spans(text)
        got = secret_scan.candidates(text, base)
        free = secret_scan.candidates(text, [])
        assert got == [c for c in free if not any(x < c[1] and c[0] < y for x, y, _ in base)]


def test_many_digests_in_one_text_are_quick():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("0123456789abcdef", k=40)) for _ in range(16_000))
    base = secret_scan.base_spans(text)
    began = time.process_time()
    assert len(base) == 16_000 and secret_scan.candidates(text, base) == []
    assert time.process_time() - began < 1.0
