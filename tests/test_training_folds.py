"""Training cuts follow the data: more blocks of users, more hours to learn from."""

import datetime as dt

from pyspark.sql import functions as F

from wattpanel.operators import folds as K
from wattpanel.plans import models as MD
from wattpanel.plans import q_models


def _hours(spark, days):
    return spark.range(24 * days).select(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))").alias("datetime"))


def test_cuts_follow_the_span(spark):
    for days in (30, 300):
        df = _hours(spark, days)
        half, late = K.fraction_cuts(df, [1 / 2, 5 / 6])
        n = [df.filter(F.col("datetime") <= F.lit(c).cast("timestamp")).count() for c in (half, late)]
        assert abs(n[0] - 12 * days) <= 1 and abs(n[1] - 20 * days) <= 1


def test_cut_is_in_the_sessions_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 1, 6),)], "datetime timestamp")
    assert df.filter(F.col("datetime") <= F.lit(K.fraction_cuts(df, [1.0])[0]).cast("timestamp")).count() == 2


def test_ensemble_trains_on_two_thirds_of_the_span(spark, monkeypatch):
    frame = _hours(spark, 300).withColumn("row_id", F.unix_timestamp("datetime")).withColumn("target", F.lit(1.0))
    seen = {}
    monkeypatch.setattr(q_models, "eval_frame", lambda *_: frame)
    monkeypatch.setattr(MD, "fit_gbt_ensemble", lambda df, *a, **k: seen.setdefault("train", df.count()))
    monkeypatch.setattr(MD, "predict_ensemble", lambda models, df, *a: df.withColumn("prediction", F.lit(0.0)))
    scored = q_models.gbt_ensemble(spark, "")
    assert abs(seen["train"] - 16 * 300) <= 1 and seen["train"] + scored.count() == 24 * 300
