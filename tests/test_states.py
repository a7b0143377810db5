"""Compacted states, tables refreshed before each prediction, the joined model's bundle, the search and fold masks."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from test_models import REG, _solar_rows
from wattpanel.operators import folds as K
from wattpanel.operators.clean import upsert_latest
from wattpanel.plans import joined as J
from wattpanel.plans import solar as SO
from wattpanel.plans import train as TR
from wattpanel.session import scratch_dir
from wattpanel.streaming import feeds
from wattpanel.streaming.inference import run_refreshed

STATE = "k long, v double, data_block_id long"


def _drops(spark, folder, drops):
    for i, rows in enumerate(drops):
        df = spark.createDataFrame(rows, STATE)
        df.coalesce(1).write.parquet(f"{folder}/drop={i}")
    return df.schema


def test_killed_and_resumed_state_equals_batch(spark):
    folder, state, ck = (scratch_dir(x) for x in ("feed-", "state-", "stream-"))
    drops = [[(k, float(10 * b + k), b) for k in range(b, b + 6)] for b in (0, 2, 1, 3, 4, 5, 6)]  # a late block among them
    schema = _drops(spark, folder, drops)
    dying = {1, 2, 5}

    def before(batch_id):
        if batch_id in dying:
            dying.remove(batch_id)
            raise RuntimeError("killed")

    for _ in range(4):
        try:
            view = feeds.stream_state(spark, folder, schema, state, ck, ["k"], 2, 1, before)
            break
        except StreamingQueryException:
            continue
    assert not dying
    want = {}
    for rows in sorted(drops, key=lambda d: d[0][2]):
        want.update({k: v for k, v, _ in rows})
    assert {r.k: r.v for r in view.collect()} == want
    assert feeds.snapshots(spark, state) == [3, 5]
    read = [r[0] for r in feeds._state_rows(spark, state, schema).select(F.input_file_name()).distinct().collect()]
    assert any("upto=5" in f for f in read) and any("batch_id=6" in f for f in read)
    assert not any(f"batch_id={b}" in f or "upto=3" in f for f in read for b in range(6))  # old batches are not read
    assert not feeds._numbers(spark, f"{state}/log/batch_id=[0-3]", lambda p: p)  # and those that no snapshot needs are gone


def test_snapshot_without_its_mark_does_not_count(spark):
    state = scratch_dir("state-")
    df = spark.createDataFrame([(1, 1.0, 0)], STATE)
    feeds.append_state(df, 0, state)
    spark.createDataFrame([(1, 9.0, 9)], STATE).write.parquet(f"{state}/snapshots/upto=0")
    path, fs = feeds._fs(spark, f"{state}/snapshots/upto=0/_SUCCESS")
    fs.delete(path, False)
    assert feeds.state_view(spark, state, df.schema, ["k"]).collect()[0].v == 1.0
    assert feeds.state_view(spark, scratch_dir("none-"), df.schema, ["k"]).collect() == []


def test_each_block_sees_the_state_of_its_time(spark):
    feed, state, ck = (scratch_dir(x) for x in ("feed-", "state-", "stream-"))
    table = spark.createDataFrame([(1, 10.0, 0), (1, 20.0, 1), (1, 30.0, 3)], STATE)
    items = spark.createDataFrame([(i, 1, i != 2, i) for i in range(4)] + [(9, 7, True, 1)], "row_id long, k long, currently_scored boolean, data_block_id long")
    table.coalesce(1).write.parquet(f"{feed}/table")
    items.coalesce(1).write.parquet(f"{feed}/items")
    run = lambda: run_refreshed(spark, feed, state, ck, {"table": table.schema, "items": items.schema}, {"table": ["k"]},
                                lambda asked, t: asked.join(t["table"].withColumnRenamed("v", "prediction"), "k", "left"), lambda f: f)
    got = {r.row_id: r.target for r in run().collect()}
    assert got == {0: 10.0, 1: 44444444.0, 9: 44444444.0, 2: 0.0, 3: 30.0}  # block 1 has an item without a row
    feeds.append_state(table.filter("data_block_id = 3"), 0, f"{state}/table", 3)  # the last step replayed
    assert {r.row_id: r.target for r in run().collect()} == got


def _joined(spark):
    rows = []
    for i in range(480):
        t = dt.datetime(2024, 1 + i // 240, 1 + (i // 24) % 10, i % 24)
        for cons in (0, 1):
            rows.append((2 * i + cons, i % 3, 0, i % 2, cons, t, float(5 + 3 * cons + (i % 24) + i % 2), 50.0 * (i % 20), 5.0, 2.0, 0.0, 0.0, 1.0, 10.0, 4.0,
                         (5 + (i % 24)) / 4.0 + 0.1 * (i % 5), (5 + (i % 24)) / 4.0, i % 24))
    cols = ("row_id long, county long, is_business long, product_type long, is_consumption long, datetime timestamp, target double, "
            "ssr double, t double, d double, s double, r double, ws double, installed_capacity double, eic_count double, "
            "target_per_eic_48h double, target_per_eic_168h double, hour long")
    return spark.createDataFrame(rows, cols)


REGS = {**REG, "installed_capacity": "installed_capacity"}
FEATURES = ["hour", "ssr", J.FIRST]
SMALL = {"maxIter": 3, "maxDepth": 3, "minInstancesPerNode": 5}
COARSE = {"min_step_fraction": 0.26}  # one round


def _fit(spark, df, combine, parts, **kw):
    return J.fit(df, parts, None, FEATURES, combine, regressors=REGS, solar_options=COARSE, trees=SMALL, seeds=(0,), **kw)


@pytest.mark.parametrize("combine, folds", [("residual", 0), ("residual", 3), ("months", 0), ("first", 0)])
def test_joined_model_round_trip(spark, combine, folds):
    df = _joined(spark).cache()
    parts = [J.Part(("hour", "target_per_eic_48h"), 48), J.Part(("hour", J.SHARE), None), J.Part((), 168)]
    model = _fit(spark, df, combine, parts, folds=folds)
    got = {r.row_id: (r.production_1, r.prediction) for r in model.predict(df).collect()}
    assert len(got) == df.count() and all(p is not None for _, p in got.values())
    path = scratch_dir("bundle-")
    model.save(path)
    model.solar.write.parquet(f"{path}/version=2/solar")  # a version that was not finished
    assert J.latest_version(spark, path) == 1
    assert {r.row_id: (r.production_1, r.prediction) for r in J.load(spark, path).predict(df).collect()} == got
    by = {r.model: r for r in J.errors(model.predict(df)).collect()}
    t = {r.row_id: (r.is_consumption, r.target) for r in df.collect()}
    for name, keep, col in (("production_1", 0, 0), ("production_2", 0, 1), ("consumption", 1, 1), ("total", None, 1)):
        errs = [abs(got[i][col] - y) for i, (c, y) in t.items() if keep is None or c == keep]
        assert by[name].n == len(errs) and abs(by[name].mae - sum(errs) / len(errs)) < 1e-9
    if combine == "residual" and not folds:
        assert by["production_2"].mae <= by["production_1"].mae + 1e-9
    if combine == "first":
        assert by["production_2"].mae == by["production_1"].mae


def test_part_without_trees_is_persistence_and_weights_hold(spark):
    df = _joined(spark)
    model = J.JoinedModel(SO.params_frame(spark, "product_type", {0: SO.DEFAULT_WEIGHTS}), [J.Part((), 48), J.Part((), 168)], [3.0, 1.0], regressors=REGS, combine="first")
    for r in model.predict(df).filter("is_consumption = 1").collect():
        assert abs(r.prediction - 4.0 * (0.75 * r.target_per_eic_48h + 0.25 * r.target_per_eic_168h)) < 1e-9


def test_bad_weights_and_bundles_are_refused(spark):
    df = _joined(spark)
    for weights in ([1.0], [0.0, 0.0], [-1.0, 2.0]):
        with pytest.raises(ValueError):
            J.fit(df, [J.Part((), 48), J.Part((), 168)], weights)
    with pytest.raises(ValueError):
        J.fit(df, [J.Part((), 48)], combine="best")
    with pytest.raises(FileNotFoundError):
        J.load(spark, scratch_dir("none-"))


def test_training_judges_both_weather_sources_on_the_same_rows(spark):
    df = _joined(spark).withColumns({"t_historical": F.col("t"), "t_forecast": F.when(F.col("row_id") % 7 != 0, F.col("t") + 1)})
    kept = []
    out = TR.train_evaluate(df, ["2024-01-06 00:00:00"], COARSE, SMALL, (0,), FEATURES, ["hour", "target_per_eic_48h"], ["2024-02"], 0,
                            regressors={**REGS, "temperature": "t_historical"}, keep=lambda name, m: kept.append((name, m.combine))).collect()
    assert kept == [("f-2024-1-6", "months"), ("f-2024-2", "months")]
    n = {(r.fold, r.weather, r.model): r.n for r in out}
    for fold in ("f-2024-1-6", "f-2024-2"):
        for m in ("production_1", "production_2", "consumption", "total"):
            assert n[fold, "historical", m] == n[fold, "forecast", m] > 0
        assert n[fold, "historical", "total"] == n[fold, "historical", "production_2"] + n[fold, "historical", "consumption"]
    totals = [r.mae for r in out if r.model == "total" and r.weather == "forecast" and r.fold != "mean"]
    assert abs([r.mae for r in out if r.fold == "mean"][0] - sum(totals) / 2) < 1e-12


def test_restarts_and_drop_one_share_the_rounds(spark):
    df = _solar_rows(spark, 40)
    state, _ = SO.fit_pattern_search(df, "g", "y", regressors=REG, restarts=3, seed=1, min_step_fraction=0.26)
    assert sorted(state) == [f"{run}_{g}" for run in range(3) for g in range(2)]
    assert len({tuple(s["theta"].values()) for s in state.values()}) > 2
    without, _ = SO.fit_pattern_search(df, "g", "y", regressors=REG, drop_one=True, min_step_fraction=0.2)
    assert sorted(without) == sorted(f"{n}_{g}" for n in SO.DEFAULT_WEIGHTS for g in range(2))
    for key, s in without.items():
        name = key.rsplit("_", 1)[0]
        assert all(s["theta"][n] == v for n, v in SO.NEUTRAL[name].items())
    # a parameter at its neutral value is the formula without it
    for name in SO.DEFAULT_WEIGHTS:
        less = {k: v for k, v in SO.DEFAULT_WEIGHTS.items() if k not in SO.NEUTRAL[name]}
        if name in ("C_rad_tot_b1", "C_rad_tot_b2"):
            continue
        both = df.select(SO.solar_output({**SO.DEFAULT_WEIGHTS, **SO.NEUTRAL[name]}, REG).alias("a"), SO.solar_output(less, REG).alias("b")).collect()
        assert all(abs(r.a - r.b) < 1e-9 for r in both), name


def test_search_does_not_multiply_rows(spark):
    df = _solar_rows(spark, 40)
    rows = df.select("g", "y", *REG.values())
    names = sorted(SO.DEFAULT_WEIGHTS)
    starts = SO._starts(rows.select("g").distinct(), "g", names, SO.DEFAULT_WEIGHTS, SO.BOUNDS, None, 0, 0, False)
    seen = []
    original = SO.cut_lineage
    SO.cut_lineage = lambda d: (seen.append(d._jdf.queryExecution().executedPlan().toString()), original(d))[1]
    try:
        SO.search(rows, "g", "y", starts, names, regressors=REG, rounds=1)
    finally:
        SO.cut_lineage = original
    assert seen and not any("Generate" in p or "Expand" in p for p in seen)


def test_fold_masks_equal_fold_rows(spark):
    df = spark.range(24 * 90).select(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("datetime"), "id")
    dates, months = ["2024-01-10", "2024-02-20"], ["2024-01", "2024-02"]
    folds = [*K.date_folds(dates), *K.month_folds(months)]
    masked = df.withColumn("_folds", K.fold_mask(folds))
    by_rows = {(r.fold, r.role): r["count"] for f in (K.temporal_folds(df, dates), K.monthly_folds(df, months)) for r in f.groupBy("fold", "role").count().collect()}
    for i, f in enumerate(folds):
        assert masked.filter(K.validates_in(i)).count() == by_rows[f.name, "val"]
        assert masked.filter(K.trains_in(i)).count() == by_rows[f.name, "train"]
    got = K.per_fold(masked, folds, {"x": F.col("id").cast("double")})
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[-1]  # folds expand after the aggregate
    assert {r.fold: r.n for r in got.collect()} == {f.name: by_rows[f.name, "val"] for f in folds}
    with pytest.raises(ValueError):
        K.fold_mask(folds * 16)
