from pyspark.sql import functions as F

from cabline.plans import batch
from cabline.plans.ingest import split
from cabline.sinks import tables as K
from cabline.sources import bindings as B
from tests.conftest import SF_SMALL


def test_valid_union_error_is_input(spark):
    trips = B.trips(spark, SF_SMALL)
    v, e = split(trips)
    assert v.count() + e.count() == trips.count()


def test_route_counts_sum_to_monthly(spark):
    v, _ = split(B.trips(spark, SF_SMALL))
    p = batch.process(v, B.zones(spark, SF_SMALL))
    m, r = batch.aggregates(p)
    rs = r.groupBy("year", "month").agg(F.sum("trip_count").alias("n"))
    bad = m.join(rs, ["year", "month"], "full_outer").filter(~F.col("trip_count").eqNullSafe(F.col("n")))
    assert bad.count() == 0


def test_rerun_changes_nothing(spark, tmp_dir):
    v, _ = split(B.trips(spark, SF_SMALL))
    p = batch.process(v, B.zones(spark, SF_SMALL))
    month = p.filter((F.col("year") == 1996) & (F.col("month") == 3))
    K.write_partitioned(p, f"{tmp_dir}/processed")
    before = spark.read.parquet(f"{tmp_dir}/processed").count()
    K.write_partitioned(month, f"{tmp_dir}/processed")  # a retried month
    K.write_partitioned(month, f"{tmp_dir}/processed", files_per_partition=3)
    assert spark.read.parquet(f"{tmp_dir}/processed").count() == before == p.count()


def test_zone_join_is_broadcast_and_scan_pruned(spark):
    v, _ = split(B.trips(spark, SF_SMALL))
    p = batch.process(v, B.zones(spark, SF_SMALL))
    plan = batch.route_analytics(p)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "l_comment" not in plan  # only the bound columns are read


def test_merge_by_key_replaces_and_keeps(spark, tmp_dir):
    old = spark.createDataFrame([(2023, 1, 10), (2023, 2, 20), (2023, 3, 30)], "year int, month int, n long")
    new = spark.createDataFrame([(2023, 3, 33), (2023, 4, 40)], "year int, month int, n long")
    first = K.merge_by_key(spark, old, f"{tmp_dir}/absent", ["year", "month"], f"{tmp_dir}/v1")
    assert first.count() == 3  # no table yet: the new rows are the table
    merged = K.merge_by_key(spark, new, f"{tmp_dir}/v1", ["year", "month"], f"{tmp_dir}/v2")
    assert sorted(tuple(r) for r in merged.collect()) == [(2023, 1, 10), (2023, 2, 20), (2023, 3, 33), (2023, 4, 40)]
    again = K.merge_by_key(spark, new, f"{tmp_dir}/v2", ["year", "month"], f"{tmp_dir}/v3")
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in merged.collect())
