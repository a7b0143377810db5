"""What a template may lose changes without a step, only A-Z are lowered, and EM runs until it has settled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wattpanel.llm import langmix, license_scan


def test_loss_grows_without_a_step(spark):
    rows = spark.range(1, 80).select("id", license_scan._needed(F.col("id")).alias("need")).orderBy("id").collect()
    need = [r["need"] for r in rows]
    assert abs(need[0] - 1) < 1e-6 and abs(need[-1] - license_scan.COVER) < 1e-6
    assert all(0 <= a - b < 0.01 for a, b in zip(need, need[1:]))
    lost = [int(i * (1 - n)) for i, n in zip(range(1, 80), need)]  # whole words
    assert all(b - a in (0, 1) for a, b in zip(lost, lost[1:]))


def test_only_ascii_letters_are_lowered(spark):
    got = spark.createDataFrame([("MIT Élan İK",)], "t string").select(license_scan._words(F.col("t"))).first()[0]
    assert got == ["mit", "Élan", "İk"]


def test_em_settles_at_the_likelihoods_top():
    rng = np.random.default_rng(4)
    n = 400
    p = np.column_stack([np.ones(n), 1 + 0.05 * rng.standard_normal(n)])  # two languages that differ little: EM is slow
    true = 0.2
    c = np.ones(n)
    shares, top = langmix._em(p, c, np.zeros(n, int), np.array([0]), np.array([[0.5, 0.5]]))
    grid = [np.log(p @ np.array([1 - x, x])).sum() for x in np.linspace(0, 1, 2001)]
    assert top[0] >= max(grid) - 0.05
    assert abs(shares.sum() - 1) < 1e-9 and true


def test_thresholds_move_smoothly_with_a_groups_size(spark):
    from wattpanel.llm import quality_rules

    def limits(n):
        rows = [("en", "a", "length", 5000 + 64 * (i % 7), n // 7 + (i < n % 7)) for i in range(7)] + [("en", "b", "length", 8000 + 64 * (i % 9), 100) for i in range(9)]
        frame = spark.createDataFrame([r for r in rows if r[4]], "lang string, source string, measure string, bucket long, n long")
        r = quality_rules.thresholds(frame).filter("source = 'a'").first()
        return r["length_low"], r["length_high"]

    width = 64
    assert all(abs(x - y) < width for x, y in zip(limits(199), limits(200)))
    assert limits(2) != limits(2000)
    assert limits(2)[1] > 8000 and limits(2000)[1] < 8000  # a small group leans on its language, a large one on itself
