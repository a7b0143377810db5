from pyspark.sql import functions as F

from wattpanel.operators.clean import upsert_latest
from wattpanel.session import scratch_dir
from wattpanel.streaming import feeds
from wattpanel.streaming.inference import run_inference


def test_stream_upsert_equals_batch(spark):
    old = spark.createDataFrame([(i, float(i)) for i in range(50)], "k long, v double")
    new = spark.createDataFrame([(i, float(i) + 0.5) for i in range(40, 60)], "k long, v double")
    folder, log, checkpoint = (scratch_dir(x) for x in ("feed-", "log-", "stream-"))
    b = sorted(tuple(r) for r in upsert_latest(old, new, ["k"]).collect())
    drops = [d.withColumn(feeds.BLOCK, F.lit(i).cast("long")) for i, d in enumerate([old, new])]
    drops[0].write.parquet(f"{folder}/drop=0")
    run = lambda: feeds.stream_upsert(spark, folder, drops[0].schema, log, checkpoint, ["k"])
    assert sorted(tuple(r) for r in run().collect()) == sorted((i, float(i)) for i in range(50))
    drops[1].write.parquet(f"{folder}/drop=1")
    assert sorted(tuple(r) for r in run().collect()) == b  # started again: goes on with the new drop alone
    ids = spark.read.parquet(log).groupBy("batch_id").count().collect()
    assert {r["count"] for r in ids} == {50, 20}
    feeds.append_log(drops[1], max(r.batch_id for r in ids), log)  # the last batch replayed
    assert sorted(tuple(r) for r in feeds.latest_view(spark, log, ["k"]).collect()) == b


def test_inference_blocks_without_scored_rows_get_zero(spark):
    rows = [(1, 0, True, 2.0), (2, 0, False, -1.0), (3, 1, False, 5.0), (4, 2, True, None)]
    items = spark.createDataFrame(rows, "row_id long, data_block_id long, currently_scored boolean, x double")
    folder, log, checkpoint = (scratch_dir(x) for x in ("feed-", "log-", "stream-"))
    items.write.parquet(folder)
    out = run_inference(spark, feeds.read_feed(spark, folder, items.schema), log, checkpoint, lambda b: b,
                        lambda f: f.withColumn("prediction", F.col("x")))
    assert {(r.row_id, r.target) for r in out.collect()} == {(1, 2.0), (2, 0.0), (3, 0.0), (4, 44444444.0)}


def test_guard_sentinels(spark):
    rows = [(1, 1.0, True), (1, -2.0, True), (2, None, True), (2, 3.0, True), (3, float("inf"), True),
            (4, 5.0, False)]
    df = spark.createDataFrame(rows, "b int, p double, need boolean")
    got = {(r.b, r.target) for r in feeds.guard_predictions(df, "p", "need", ["b"]).collect()}
    assert got == {(1, 1.0), (1, 0.0), (2, 44444444.0), (3, 99999999.0), (4, 0.0)}
