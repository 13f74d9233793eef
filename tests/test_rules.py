import datetime as dt

from pyspark.sql import functions as F

from cabline.operators.rules import calendar_filter, failed_rules, split_valid, within_bounds
from cabline.plans.ingest import split
from tests.fixtures import CASES, frame


def _names(df):
    return {r["case"] for r in df.select("case").collect()}


def test_each_rule_case(spark):
    valid, error = split(frame(spark))
    v, e = _names(valid), _names(error)
    for name, _, expected, _ in CASES:
        assert (name in v) == (expected == "valid"), name
        assert (name in e) == (expected == "error"), name


def test_quarantine_partitions_input(spark):
    df = frame(spark)
    valid, error = split(df)
    assert valid.count() + error.count() == df.count()
    assert valid.join(error, "case").count() == 0


def test_compat_policy_loses_null_rule_rows(spark):
    valid, error = split(frame(spark), null_policy="drop")
    lost = {n for n, _, _, ref in CASES if ref == "lost"}
    seen = _names(valid) | _names(error)
    assert lost.isdisjoint(seen)
    assert seen | lost == {n for n, *_ in CASES}


def test_defaults_filled(spark):
    valid, _ = split(frame(spark))
    r = {x["case"]: x for x in valid.collect()}
    assert r["passenger_null"]["passenger_count"] == 1
    assert r["ratecode_null"]["RatecodeID"] == 99.0
    assert r["flag_null"]["store_and_fwd_flag"] == "N"
    assert r["airport_fee_null"]["airport_fee"] == 0.0
    assert r["congestion_null"]["congestion_surcharge"] == 0.0


def test_failed_rule_names(spark):
    _, error = split(frame(spark))
    got = {r["case"]: r["f"] for r in error.select("case", failed_rules().alias("f")).collect()}
    assert got["flag_x"] == ["flag_known"]
    assert got["distance_null"] == ["distance_positive"]
    assert set(got["pickup_null"]) >= {"pickup_present", "dropoff_after_pickup"}


def test_outlier_bounds(spark):
    df = spark.createDataFrame(
        [(5.0, 10.0), (120.0, 10.0), (5.01, 160.0), (119.99, 160.01), (None, 10.0), (60.0, 160.0)],
        "trip_speed_kph double, trip_distance_km double",
    )
    kept = {(r[0], r[1]) for r in within_bounds(df).collect()}
    assert kept == {(5.01, 160.0), (60.0, 160.0)}


def test_split_rejects_unknown_policy(spark):
    import pytest

    with pytest.raises(ValueError):
        split_valid(frame(spark), null_policy="nope")


def test_calendar_filter_is_range_and_pushed(spark, tmp_dir):
    rows = [(dt.datetime(2023, 1, 31, 23, 59, 59),), (dt.datetime(2023, 2, 1, 0, 0, 0),),
            (dt.datetime(2023, 2, 28, 23, 0, 0),), (dt.datetime(2023, 3, 1, 0, 0, 0),)]
    spark.createDataFrame(rows, "ts timestamp").write.parquet(f"{tmp_dir}/t")
    df = calendar_filter(spark.read.parquet(f"{tmp_dir}/t"), "ts", 2023, 2)
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan
    assert calendar_filter(spark.read.parquet(f"{tmp_dir}/t"), "ts", 2023, 2, 28, 23).count() == 1
    assert calendar_filter(spark.read.parquet(f"{tmp_dir}/t"), "ts", 2023, 1, 31).count() == 1
    _ = F  # noqa
