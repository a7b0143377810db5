"""Readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one test table; projection and filters are pushed by Catalyst (A2)."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV scan with a declared schema and a fixed column list (A1).

    Dates and timestamps are parsed by the schema; no inference pass over the data.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
        .option("dateFormat", "yyyy-MM-dd")
        .csv(path)
    )
    return df.select(*(columns or schema.fieldNames()))


def read_id_map(spark: SparkSession, path: str, key: str = "county", value: str = "county_name") -> DataFrame:
    """JSON object file ``{"0": "Harjumaa", ...}`` to a two-column dimension (A3)."""
    raw = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("k", "v")).select(
        F.col("k").cast("long").alias(key), F.col("v").alias(value)
    )


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet sink for features and stations (A4)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header (A5)."""
    df.write.mode(mode).option("header", True).csv(path)


def parse_date_columns(df: DataFrame, candidates=("datetime", "date", "forecast_date", "origin_datetime",
                                                   "forecast_datetime", "prediction_datetime")) -> DataFrame:
    """Turn date-like string columns into timestamps where present."""
    kinds = dict(df.dtypes)
    out = df
    for c in candidates:
        if kinds.get(c) == "string":
            out = out.withColumn(c, F.to_timestamp(c))
    return out


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order and force its types on new data (B1)."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def prepare_test_items(df: DataFrame, keep: list[str]) -> DataFrame:
    """Rename ``prediction_datetime`` to ``datetime`` and keep the item columns (B2)."""
    if "prediction_datetime" in df.columns:
        df = df.withColumnRenamed("prediction_datetime", "datetime")
    return df.select(*keep)
