import datetime as dt

from pyspark.sql import functions as F

from wattpanel.functions import scalars as S
from wattpanel.functions.holidays import holiday_table


def test_segment_key_null_part(spark):
    df = spark.createDataFrame([(1, 0, 2, 1), (None, 0, 2, 1)], "county int, is_business int, product_type int, "
                                                                "is_consumption int")
    got = [r.k for r in df.select(S.segment_key().alias("k")).collect()]
    assert got == ["1_0_2_1", None]


def test_wind_factor_boundary(spark):
    df = spark.createDataFrame([(1.9,), (2.0,), (4.0,)], "ws double")
    got = [r.w for r in df.select(S.wind_factor("ws").alias("w")).collect()]
    assert got == [1.0, 0.5, 0.25]


def test_per_unit_and_ratio_guards(spark):
    df = spark.createDataFrame([(10.0, 0.0, -0.001), (10.0, 4.0, 1.0)], "x double, d double, den double")
    r = df.select(S.per_unit("x", "d").alias("p"), S.ratio("x", "den").alias("r")).collect()
    assert r[0].p == 10.0 and r[0].r is None
    assert r[1].p == 2.5 and abs(r[1].r - 10.0 / 1.001) < 1e-12


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (3.0,)], "x double")
    assert [r.c for r in df.select(S.clip_floor("x").alias("c")).collect()] == [0.0, None, 3.0]


def test_format_and_product_names(spark):
    df = spark.createDataFrame([("LÄÄNE-VIRUMAA", 0), ("ida-virumaa", 3), ("harjumaa", 9)], "n string, p int")
    r = df.select(S.format_name("n").alias("f"), S.product_name("p").alias("pn")).collect()
    assert [x.f for x in r] == ["Lääne-Virumaa", "Ida-Virumaa", "Harjumaa"]
    assert [x.pn for x in r] == ["Combined", "Spot", None]


def test_holidays_easter_based(spark):
    days = {r.date for r in holiday_table(spark, 2024, 2025).collect()}
    assert dt.date(2024, 3, 29) in days and dt.date(2024, 3, 31) in days and dt.date(2024, 5, 19) in days
    assert dt.date(2025, 4, 18) in days and dt.date(2025, 4, 20) in days and dt.date(2025, 6, 8) in days
    assert dt.date(2024, 2, 24) in days and dt.date(2024, 12, 26) in days
    assert len(days) == 24


def test_swap_hist_forecast(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5.0)],
                               "t_historical double, t_forecast double, r_historical double, "
                               "s_historical_h48 double, w_forecast double")
    out = S.swap_hist_forecast(df)
    assert sorted(out.columns) == ["s_historical_h48", "t_historical", "w_forecast"]
    assert out.first().t_historical == 2.0


def test_downcast(spark):
    df = spark.createDataFrame([(1.5, 2)], "x double, n int")
    assert dict(S.downcast_floats(df).dtypes) == {"x": "float", "n": "int"}


def test_wind_uv_angle_option(spark):
    df = spark.createDataFrame([(2.0, 90.0)], "ws double, d double")
    u, v = S.wind_uv("ws", "d", "radians")
    r = df.select(u.alias("u"), v.alias("v")).first()
    assert abs(r.u) < 1e-12 and abs(r.v - 2.0) < 1e-12
    assert F is not None
