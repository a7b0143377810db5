import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F

from wattpanel import schemas
from wattpanel.sources import io


def test_csv_scan_with_schema_and_sink(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    path = os.path.join(d, "client.csv")
    with open(path, "w") as f:
        f.write("product_type,county,eic_count,installed_capacity,is_business,date,extra\n")
        f.write("1,0,108.0,952.89,0,2021-09-01,x\n3,5,17.0,166.4,1,2021-09-02,y\n")
    df = io.read_csv(spark, path, schemas.CLIENT.add("extra", "string"), schemas.CLIENT.fieldNames()[:6])
    assert df.columns == schemas.CLIENT.fieldNames()[:6]
    r = df.orderBy("county").first()
    assert r.date == dt.date(2021, 9, 1) and r.eic_count == 108.0
    out = os.path.join(d, "out")
    io.write_csv(df, out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2


def test_id_map_and_name_lookup(spark):
    d = tempfile.mkdtemp(prefix="map-")
    path = os.path.join(d, "ids.json")
    with open(path, "w") as f:
        json.dump({"0": "Harjumaa", "1": "Hiiumaa", "12": "Unknown"}, f)
    m = io.read_id_map(spark, path)
    assert sorted((r.county, r.county_name) for r in m.collect()) == [(0, "Harjumaa"), (1, "Hiiumaa"), (12, "Unknown")]
    from wattpanel.operators.clean import name_to_id
    q = spark.createDataFrame([("Hiiumaa",), ("Nowhere",)], "name string")
    got = {r.name: r.county for r in name_to_id(q, m, "name").collect()}
    assert got == {"Hiiumaa": 1, "Nowhere": None}


def test_parquet_sink_partitioned(spark):
    d = tempfile.mkdtemp(prefix="pq-")
    df = spark.createDataFrame([(1, "2024-01"), (2, "2024-02")], "x int, month string")
    io.write_parquet(df, d, ["month"])
    assert {"month=2024-01", "month=2024-02"} <= set(os.listdir(d))
    assert spark.read.parquet(d).filter(F.col("month") == "2024-02").count() == 1


def test_parse_dates_conform_and_items(spark):
    df = spark.createDataFrame([("2024-01-01 05:00:00", "3", 1.5, True)],
                               "prediction_datetime string, county string, target double, currently_scored boolean")
    p = io.parse_date_columns(df)
    assert dict(p.dtypes)["prediction_datetime"] == "timestamp"
    items = io.prepare_test_items(p, ["datetime", "county"])
    assert items.columns == ["datetime", "county"]
    c = io.conform(items.withColumn("county", F.col("county")), schemas.TARGET.__class__(
        [f for f in schemas.TARGET.fields if f.name in ("datetime", "county")]))
    assert dict(c.dtypes)["county"] == "int"
