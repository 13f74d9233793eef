"""Monthly files whose types drift, read as one table."""

import pytest
from pyspark.sql import functions as F

from cabline.schema import TRIP_COLUMNS
from cabline.sources import months as MO
from cabline.sources.trips import trip_file
from tests.fixtures import frame


def _months(spark, root):
    """January INT, February BIGINT and another spelling, March DOUBLE, April without the column, May as January."""
    t = frame(spark).drop("case")
    forms = {
        1: t,
        2: t.withColumn("passenger_count", F.lit(3_000_000_000)).withColumnRenamed("airport_fee", "Airport_fee"),
        3: t.withColumn("passenger_count", F.col("passenger_count").cast("double")),
        4: t.drop("passenger_count").withColumn("extra_column", F.lit("x")),
        5: t,
    }
    for m, df in forms.items():
        moved = df.withColumn("tpep_pickup_datetime", F.add_months("tpep_pickup_datetime", m - 1).cast("timestamp"))
        moved.write.parquet(trip_file(root, "yellow", 2023, m))
    t.write.parquet(trip_file(root, "green", 2023, 1))
    return t


def test_months_of_drifting_types(spark, tmp_dir):
    t = _months(spark, tmp_dir)
    assert MO.available_months(spark, tmp_dir, "yellow") == [(2023, m) for m in range(1, 6)]
    out = MO.read_months(spark, tmp_dir, "yellow", (2023, 1), (2023, 4))
    assert tuple(out.columns) == TRIP_COLUMNS and out.count() == 4 * t.count()
    counts = {r[0]: (r[1], r[2]) for r in out.groupBy(F.month("tpep_pickup_datetime")).agg(F.sum("passenger_count"), F.sum("airport_fee")).collect() if r[0]}
    assert counts[1][0] == counts[3][0] and counts[2][0] is None and counts[4][0] is None  # too large for the standard type, absent
    assert all(fee == counts[1][1] for _, fee in counts.values())


def test_scans_follow_schemas_and_filters_reach_them(spark, tmp_dir):
    _months(spark, tmp_dir)
    out = MO.read_months(spark, tmp_dir, "yellow")
    assert len(MO.group_by_schema(spark, [trip_file(tmp_dir, "yellow", 2023, m) for m in range(1, 6)])) == 4
    picked = out.where(F.col("tpep_pickup_datetime") >= F.lit("2023-03-01").cast("timestamp")).select("tpep_pickup_datetime", "PULocationID")
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and plan.count("GreaterThanOrEqual(tpep_pickup_datetime") == 4
    assert "fare_amount" not in plan
    span = MO.read_months(spark, tmp_dir, "yellow", (2023, 2), (2023, 3))
    assert {f.split("_tripdata_")[1][:7] for f in span.inputFiles()} == {"2023-02", "2023-03"}


def test_absent_months(spark, tmp_dir):
    _months(spark, tmp_dir)
    with pytest.raises(FileNotFoundError):
        MO.read_months(spark, tmp_dir, "yellow", (2030, 1))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        MO.read_drifting(spark, [f"{tmp_dir}/none.parquet"])
    empty = MO.read_drifting(spark, [])
    assert tuple(empty.columns) == TRIP_COLUMNS and empty.count() == 0
