"""Secrets in paths and joined names, and short keys of letters, are candidates."""

from __future__ import annotations

import random
import string

from wattpanel.llm import secret_scan


def found(text, limit=25):
    return [(text[a:b], kind) for a, b, kind in secret_scan.all_spans(text, dict.fromkeys(range(6), limit))[1]]


def test_key_in_a_path_with_a_hyphen():
    for path in ("my-app/", "myapp/", "my_app+x/"):
        spans = found(f"see https://host.example/hooks/{path}9fX2kQ7bLr8TzW4mVc1Y now")
        assert any("9fX2kQ7bLr8TzW4mVc1Y" in text for text, _ in spans), spans
    assert found("see https://host.example/some-long/path-of-words/and_more-words/without-a-key/at-all") == []


def test_run_of_signs_without_digits_and_letters_alone():
    rng = random.Random(4)
    for n in (16, 19, 22):
        hits = 0
        for _ in range(200):
            key = "".join(rng.choice(string.ascii_letters) for _ in range(n))
            hits += bool(found(f"a {key} b")) + bool(found(f"name-of/{key} b"))
        assert hits > 0.95 * 400
    names = ("internationalizationName", "getCurrentUserName", "maxConnectionPool", "parseRequestBody", "someLongVariable")
    assert all(secret_scan.judge(x) is None or secret_scan.judge(x)[2] > 10 for x in names)


def test_a_whole_key_is_reported_once():
    rng = random.Random(5)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(20)) + "/" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(20))
    assert found(f"x {key} y") == [(key, "random_base64")]
