import datetime as dt
import tempfile

from pyspark.sql import functions as F

from wattpanel.plans import models as MD
from wattpanel.plans import solar as SO

REG = {"temperature": "t", "dewpoint": "d", "shortwave_radiation": "ssr", "snowfall": "s", "rain": "r",
       "windspeed_10m": "ws", "installed_capacity": "cap"}


def _solar_rows(spark, n=400):
    rows = []
    for i in range(n):
        g = i % 2
        ssr = 50.0 * (i % 20)
        cap = 10.0 + (i % 7)
        rows.append((g, 5.0 + i % 10, 2.0 + i % 5, ssr, 0.1 * (i % 3), 0.01 * (i % 4), 1.0 + i % 6, cap))
    df = spark.createDataFrame(rows, "g long, t double, d double, ssr double, s double, r double, ws double, "
                                     "cap double")
    truth = dict(SO.DEFAULT_WEIGHTS, C_area=6.0)
    return df.withColumn("y", SO.solar_output(truth, REG))


def test_radiation_pieces_and_jump(spark):
    df = spark.createDataFrame([(x * 1000.0,) for x in (0.05, 0.3, 0.7)], "ssr double")
    params = {"C_rad_tot_k1": 0.3, "C_rad_tot_k2": 0.74, "C_rad_tot_k3": 0.4, "C_rad_tot_b1": 0.097,
              "C_rad_tot_b2": 0.6, "C_area": 1.0}
    df = df.withColumns({"cap": F.lit(1.0), "t": F.lit(10.0), "d": F.lit(5.0), "s": F.lit(0.0), "r": F.lit(0.0),
                         "ws": F.lit(1.0)})
    got = [r.p for r in df.select(SO.solar_output(params, REG).alias("p")).collect()]
    want = [0.05 * 0.3, (0.3 - 0.097) * 0.74 + 0.097 * 0.3, (0.7 - 0.6) * 0.4 + 0.6 * 0.74 + 0.097 * 0.3]
    assert all(abs(a - 0.17 * b) < 1e-12 for a, b in zip(got, want))


def test_pattern_search_monotone_and_bounded(spark):
    df = _solar_rows(spark)
    state, hist = SO.fit_pattern_search(df, "g", "y", regressors=REG, rounds=6)
    for g, s in state.items():
        seq = [h[str(g)] for h in hist]
        assert all(b <= a + 1e-12 for a, b in zip(seq, seq[1:]))
        for n, v in s["theta"].items():
            lo, hi = SO.BOUNDS[n]
            assert lo <= v <= hi
        assert seq[-1] < seq[0]


def test_group_predict_unseen_is_average(spark):
    df = _solar_rows(spark, 40).withColumn("g", F.when(F.col("g") == 1, F.lit(5)).otherwise(F.col("g")))
    params = SO.params_frame(spark, "g", {0: SO.DEFAULT_WEIGHTS, 1: dict(SO.DEFAULT_WEIGHTS, C_area=2.0)})
    out = SO.group_predict(df, params, "g", REG).filter(F.col("g") == 5)
    chk = out.withColumn("a", SO.solar_output(SO.DEFAULT_WEIGHTS, REG)).withColumn(
        "b", SO.solar_output(dict(SO.DEFAULT_WEIGHTS, C_area=2.0), REG))
    for r in chk.collect():
        assert abs(r.prediction - (r.a + r.b) / 2) < 1e-9


def test_gbt_ensemble_save_load(spark):
    rows = [(float(i % 10), float(i % 3), float(2 * (i % 10) + (i % 3))) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    models = MD.fit_gbt_ensemble(df, ["a", "b"], "y", seeds=(0, 1), params={"maxIter": 5, "maxDepth": 3,
                                                                          "minInstancesPerNode": 5})
    p1 = MD.predict_ensemble(models, df, ["a", "b"]).select("prediction").collect()
    path = tempfile.mkdtemp(prefix="gbt-")
    MD.save_models(models, path)
    p2 = MD.predict_ensemble(MD.load_models(path, 2), df, ["a", "b"]).select("prediction").collect()
    assert p1 == p2


def test_model_algebra(spark):
    df = spark.createDataFrame([(10.0, 0.0, 4.0, dt.datetime(2024, 1, 5), 3.0, 5.0),
                                (10.0, 5.0, 0.0, dt.datetime(2024, 6, 5), -3.0, 5.0)],
                               "target double, installed_capacity double, eic_count double, ts timestamp, "
                               "first double, second double")
    r = df.select(MD.capacity_target().alias("yc"), MD.eic_target().alias("ye"),
                  MD.month_switch("first", "second", "ts").alias("m"),
                  MD.weighted_average(["first", "second"], [3.0, 1.0]).alias("w")).collect()
    assert [x.yc for x in r] == [10.0, 2.0] and [x.ye for x in r] == [2.5, 10.0]
    assert [x.m for x in r] == [3.0, 5.0] and [x.w for x in r] == [3.5, -1.0]
