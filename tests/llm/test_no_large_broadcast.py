"""Spark's size estimate misses what mapInArrow and explode add, so the SimHash joins must not rest on it."""

import pytest
from wattpanel.llm import simhash


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def ten_mb(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_key_rows_are_not_broadcast(ten_mb, monkeypatch, tmp_path):
    plans, components = [], simhash.components

    def kept(edges):
        edges.collect()  # the repartitioned nodes have their size only while the query runs
        plans.append(_plan(edges))
        return components(edges)

    monkeypatch.setattr(simhash, "components", kept)
    prints = ten_mb.createDataFrame([(f,) for f in (0, 7, 1 << 40, (1 << 40) + 3, 0x5555555555555555)], "fp long")
    prints.write.parquet(f"{tmp_path}/prints")  # a file has a size that Spark goes by
    got = {r["fp"]: r["comp"] for r in simhash.link(ten_mb.read.parquet(f"{tmp_path}/prints")).collect()}
    assert got == {0: 0, 7: 0, 1 << 40: 0, (1 << 40) + 3: 0, 0x5555555555555555: 0x5555555555555555}
    keyed = [p.split("Initial Plan")[0] for p in plans if "MapInArrow" in p]
    assert len(keyed) == 1 and "SortMergeJoin" in keyed[0] and "BroadcastHashJoin" not in keyed[0]


def test_steps_of_many_edges_are_not_broadcast(ten_mb, monkeypatch, tmp_path):
    ten_mb.createDataFrame([(3, 2), (2, 1), (9, 8)], "u long, v long").write.parquet(f"{tmp_path}/edges")
    edges = ten_mb.read.parquet(f"{tmp_path}/edges")
    plans, star = [], simhash._star

    def kept(*args):
        plans.append(_plan(star(*args)))
        return star(*args)

    monkeypatch.setattr(simhash, "_star", kept)
    monkeypatch.setattr(simhash, "MANY_EDGES", 2, raising=False)
    assert sorted(tuple(r) for r in simhash.components(edges).collect()) == [(2, 1), (3, 1), (9, 8)]
    assert plans and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)
