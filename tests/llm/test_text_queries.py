"""Registered text queries: against their SQL, and the pipeline end to end."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wattpanel.llm import decontam, secret_scan, simhash
from wattpanel.llm.common import read
from wattpanel.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(ORACLES[name]).df()
    got = QUERIES[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert (a == b).all().all()


def test_one_query_for_each_operator():
    assert [int(n.split("_")[0][2:]) for n in QUERIES] == list(range(1, 14))


def test_pipeline(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns, name
            assert 0 < after.count() <= before.count(), name
        before = after
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*columns, "mix_shard", "mix_copy", "mix_words", "mix_order"]
    order = ["doc_id", "mix_shard", "mix_copy", "mix_words", "mix_order"]
    assert out.select(order).orderBy(order).collect() == before.select(order).orderBy(order).collect()
    assert decontam.overlaps(out, read(spark, SF, "benchmark")).count() == 0
    assert secret_scan.scan(out).agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0
    distinct = out.select("doc_id").distinct().count()
    whole = out.filter("mix_copy = 1").dropDuplicates(["doc_id"])
    assert simhash.near_duplicates(whole.filter(F.size(F.split("text", r"\s+")) == F.col("mix_words"))).select("component_id").distinct().count() <= distinct
