import datetime as dt

from pyspark.sql import functions as F

from wattpanel.operators.windows import sliding_sum
from wattpanel.plans import features as FT

B = dt.datetime(2024, 1, 1)


def _forecast(spark):
    # Two issues (day 1 and day 2) valid at the same hour for one grid point.
    rows = [(58.0, 22.0, B, 24 + 23, 1.0, 0.5, 0.001, 0.0, 1.0, 1.0, 100.0),
            (58.0, 22.0, B + dt.timedelta(days=1), 23, 2.0, 1.5, 0.002, 0.0, 1.0, 1.0, 200.0)]
    return spark.createDataFrame(rows, "latitude double, longitude double, origin_datetime timestamp, "
                                       "hours_ahead int, temperature double, dewpoint double, "
                                       "total_precipitation double, snowfall double, "
                                       "`10_metre_u_wind_component` double, `10_metre_v_wind_component` double, "
                                       "surface_solar_radiation_downwards double")


def test_issue_overlap_parity_and_latest_only(spark):
    fw = _forecast(spark)
    both, _ = FT.prepare_forecast_weather(fw)
    latest, _ = FT.prepare_forecast_weather(fw, latest_issue_only=True)
    assert both.count() == 2  # parity (Q5): both issues kept for the same valid hour
    r = latest.collect()
    assert len(r) == 1 and r[0].temperature == 2.0 and r[0].datetime == B + dt.timedelta(hours=47)


def test_sliding_window_min_start(spark):
    rows = [(1, B + dt.timedelta(hours=h), 1.0) for h in range(48)]
    df = spark.createDataFrame(rows, "county int, datetime timestamp, rain double")
    all_w = sliding_sum(df, ["county"], "datetime", "rain", "7 days", "1 day", "s")
    cut = sliding_sum(df, ["county"], "datetime", "rain", "7 days", "1 day", "s", min_start=B)
    assert all_w.count() == 8  # windows ending Jan 2 .. Jan 9 all overlap the data (Q9)
    ends = sorted(r.datetime for r in cut.collect())
    assert ends == [B + dt.timedelta(days=7), B + dt.timedelta(days=8)]  # windows starting Jan 1 and Jan 2
    assert cut.agg(F.sum("s")).first()[0] == 48.0 + 24.0
