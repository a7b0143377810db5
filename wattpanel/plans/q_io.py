"""Readers, sinks and schema steps on the given tables: what is written comes back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from ..sources import io
from .registry import query

ORDERS = T.StructType([
    T.StructField("o_orderkey", T.LongType()),
    T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()),
    T.StructField("o_totalprice", T.DoubleType()),
    T.StructField("o_orderdate", T.TimestampType()),
    T.StructField("o_orderpriority", T.StringType()),
])


@query("csv_scan_sink", "SELECT o_orderkey, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def csv_scan_sink(spark, sf):
    """A1, A5: orders to CSV and back, four of its columns."""
    path = scratch_dir("csv-")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate")
    io.write_csv(io.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", stamp, "o_orderpriority"), path)
    return io.read_csv(spark, path, ORDERS, ["o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"])


@query("parquet_sink", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def parquet_sink(spark, sf):
    """A4: orders to Parquet, partitioned by status, and back."""
    path = scratch_dir("parquet-")
    io.write_parquet(io.read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).withColumn("o_orderstatus", F.col("o_orderstatus").cast("string"))


JSON_ENTRIES = 10_000


@query("json_id_map", "SELECT s_suppkey AS county, s_name AS county_name FROM supplier")
def json_id_map(spark, sf):
    """A3: the supplier dimension as JSON objects of id to name, a file for about every ``JSON_ENTRIES`` names, read back as a table."""
    path = scratch_dir("json-")
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), F.col("s_name"))))
    names = io.read_table(spark, sf, "supplier")
    files = names.count() // JSON_ENTRIES + 1
    parts = names.groupBy(F.pmod(F.xxhash64("s_suppkey"), F.lit(files)).alias("part")).agg(F.to_json(entries).alias("value"))
    parts.write.partitionBy("part").text(path)
    return io.read_id_map(spark, path)


@query("parse_date_columns", "SELECT event_id, ts AS datetime, date_trunc('day', ts)::TIMESTAMP AS date FROM events")
def parse_date_columns(spark, sf):
    """Date-like strings become timestamps."""
    e = io.read_table(spark, sf, "events")
    text = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("datetime"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    return io.parse_date_columns(text)


@query("conform_schema", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def conform_schema(spark, sf):
    """B1: columns in another order and as strings get the declared order and types."""
    o = io.read_table(spark, sf, "orders")
    loose = o.select(*[F.col(c).cast("string").alias(c) for c in reversed(o.columns)], F.lit(1).alias("extra"))
    return io.conform(loose, ORDERS)


@query("prepare_test_items", "SELECT event_id AS row_id, ts AS datetime, user_id FROM events")
def prepare_test_items(spark, sf):
    """B2: prediction_datetime becomes datetime; only the item columns stay."""
    e = io.read_table(spark, sf, "events").select(F.col("event_id").alias("row_id"), F.col("ts").alias("prediction_datetime"), "user_id", "value")
    return io.prepare_test_items(e, ["row_id", "datetime", "user_id"])
