"""A language of under a tenth of a long text is in its set; a text of one language stays so."""

from __future__ import annotations

import random

from wattpanel.llm import langmix

WORDS = {"en": "the house stands near river under old trees where children play after school".split(), "de": "das haus steht nahe dem fluss unter alten baeumen wo kinder nach der schule spielen".split(), "fr": "la maison se trouve pres de riviere sous vieux arbres enfants jouent apres ecole".split()}


def test_share_under_a_tenth_is_reported(spark):
    rng = random.Random(6)
    text = lambda k, n: " ".join(rng.choice(WORDS[k]) for _ in range(n))
    labelled = spark.createDataFrame([(i, k, text(k, 400)) for i, k in enumerate(sorted(WORDS) * 5)], "doc_id long, lang string, text string")
    docs = spark.createDataFrame([(0, text("en", 18400) + " " + text("de", 1600)), (1, text("en", 20000)), (2, text("fr", 300))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langmix.identify(docs, labelled).collect()}
    shares = dict(x.split(":") for x in got[0]["languages"].split(","))
    assert got[0]["lang_pred"] == "en" and set(shares) == {"en", "de"} and 0.04 < float(shares["de"]) < 0.1
    assert got[1]["languages"] == "en:1.000" and got[2]["languages"] == "fr:1.000"
