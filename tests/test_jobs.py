from pyspark.sql import functions as F

from cabline.operators.replay import to_messages
from cabline.plans import jobs
from cabline.plans.ingest import split
from cabline.sinks.tables import write_partitioned
from cabline.sources import bindings as B
from cabline.sources.zones import write_zones_csv
from cabline.streaming.ingest import StreamSource
from tests.conftest import SF_SMALL


def test_stream_then_monthly_batch_then_retrain(spark, tmp_dir):
    # two months of trips, so the hourly (4-level) store stays small
    trips = B.trips(spark, SF_SMALL).filter(
        (F.col("tpep_pickup_datetime") >= F.lit("1996-03-01").cast("timestamp"))
        & (F.col("tpep_pickup_datetime") < F.lit("1996-05-01").cast("timestamp"))
    )
    to_messages(trips).repartition(4, "key").select("value").write.text(f"{tmp_dir}/topic")
    sp = jobs.StreamPaths(f"{tmp_dir}/raw/valid", f"{tmp_dir}/raw/error", f"{tmp_dir}/state",
                          f"{tmp_dir}/messages", f"{tmp_dir}/ck")
    src = StreamSource(format="text", path=f"{tmp_dir}/topic", max_files_per_trigger=2)
    qs = jobs.streaming_ingest(spark, src, sp, available_now=True)
    for q in qs:
        q.awaitTermination()
    valid, _ = split(trips)
    assert jobs.running_total(spark, sp.state).first()["total"] == valid.count()

    write_zones_csv(B.zones(spark, SF_SMALL), f"{tmp_dir}/zones")
    bp = jobs.BatchPaths(sp.raw_valid, f"{tmp_dir}/zones", f"{tmp_dir}/processed", f"{tmp_dir}/fact",
                         f"{tmp_dir}/by_time", f"{tmp_dir}/by_routes")
    out1 = jobs.monthly_batch(spark, bp, 1996, 3)
    out2 = jobs.monthly_batch(spark, bp, 1996, 3)  # retried run
    assert out1 == out2 and out1["processed_rows"] > 0
    assert spark.read.parquet(bp.processed).count() == out1["processed_rows"]
    assert spark.read.parquet(bp.fact_trips).count() == out1["processed_rows"]
    t = spark.read.parquet(bp.analyze_by_time).collect()
    assert len(t) == 1 and t[0]["trip_count"] == out1["processed_rows"]
    r = spark.read.parquet(bp.analyze_by_routes).agg(F.sum("trip_count")).first()[0]
    assert r == out1["processed_rows"]

    # a second month lands next to the first
    jobs.monthly_batch(spark, bp, 1996, 4)
    assert spark.read.parquet(bp.analyze_by_time).count() == 2

    model = jobs.retrain(spark, bp.processed, f"{tmp_dir}/model", gap="skip", num_trees=5)
    assert model.stages[-1].getNumTrees == 5


def test_write_partitioned_rebalance_hot_value(spark, tmp_dir):
    df = spark.range(20000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    write_partitioned(df, f"{tmp_dir}/t", ("k",))
    back = spark.read.parquet(f"{tmp_dir}/t")
    assert back.count() == 20000 and back.filter("k = 1").count() == 6667
