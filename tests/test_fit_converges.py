"""The pattern search runs until its steps are small, and says so."""

import inspect

from wattpanel.plans import q_models
from wattpanel.plans import solar as SO
from wattpanel.plans import train

from test_models import REG, _solar_rows


COARSE = 0.02  # four halvings, so that the test is short


def test_search_converges_by_default_and_tells_when_it_does_not(spark):
    df = _solar_rows(spark, 60)
    state, hist = SO.fit_pattern_search(df, "g", "y", regressors=REG, min_step_fraction=COARSE)
    assert all(s["converged"] and 4 <= s["rounds"] <= len(hist) for s in state.values())
    short, _ = SO.fit_pattern_search(df, "g", "y", regressors=REG, rounds=2, min_step_fraction=COARSE)
    assert not any(s["converged"] for s in short.values()) and all(s["rounds"] == 2 for s in short.values())
    assert all(state[g]["mae"] <= short[g]["mae"] for g in state)


def test_solar_fit_sets_no_rounds_and_returns_converged(spark, monkeypatch):
    given = []

    def fit(df, group_col, target, **options):
        given.append(options)
        return {0: {"theta": dict(SO.DEFAULT_WEIGHTS), "mae": 1.0, "n": 3, "rounds": 15, "converged": True}}, []

    monkeypatch.setattr(q_models, "solar_frame", lambda *_: spark.createDataFrame([(0,)], "product_type long"))
    monkeypatch.setattr(SO, "fit_pattern_search", fit)
    for rows in (q_models.solar_fit(spark, "").collect(), q_models.param_stability(spark, "").collect()):
        assert rows and all(r["converged"] and r["rounds"] == 15 for r in rows)
    assert not any("rounds" in o for o in given)


def test_training_takes_features_from_the_caller():
    assert {"second_order_features", "diff_features", "solar_options"} <= set(inspect.signature(train.train_evaluate).parameters)
