import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from cabline.operators.ordered import next_value, previous_value, running_sum


def _data(spark, n=400, seed=7):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        t = base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 70))
        rows.append((i, rnd.choice(["a", "b", "c"]), t, rnd.randint(0, 9)))
    rows.append((n, "a", rows[0][2], 5))  # a tie on ts, broken by id
    return spark.createDataFrame(rows, "id long, g string, ts timestamp, v long")


def test_previous_value_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    got = {r["id"]: r["p"] for r in previous_value(df, "ts", "v", "p", "g", "id", bucket_unit="day").collect()}
    assert got == want


def test_next_value_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    want = {r["id"]: r["p"] for r in df.withColumn("p", F.lead("v").over(w)).collect()}
    got = {r["id"]: r["p"] for r in next_value(df, "ts", "v", "p", "g", "id", bucket_unit="week").collect()}
    assert got == want
    # no partition key at all
    w0 = Window.orderBy("ts", "id")
    want0 = {r["id"]: r["p"] for r in df.withColumn("p", F.lead("v").over(w0)).collect()}
    got0 = {r["id"]: r["p"] for r in next_value(df, "ts", "v", "p", None, "id", bucket_unit="month").collect()}
    assert got0 == want0


def test_running_sum_matches_window(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r["id"]: r["s"] for r in df.withColumn("s", F.sum("v").over(w)).collect()}
    got = {r["id"]: r["s"] for r in running_sum(df, "ts", "v", "s", "g", "id", bucket_unit="day").collect()}
    assert got == want


def test_no_single_partition_exchange_on_rows(spark):
    df = _data(spark)
    plan = running_sum(df, "ts", "v", "s", "g", "id", bucket_unit="day")._jdf.queryExecution().executedPlan()
    text = plan.toString()
    # the only SinglePartition-free ordering of raw rows: partitioned by (g, bucket)
    assert "hashpartitioning(g" in text


def test_hot_buckets_are_split_without_changing_results(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    ws = w.rowsBetween(Window.unboundedPreceding, 0)
    lag_want = {r["id"]: r["p"] for r in df.withColumn("p", F.lag("v").over(w)).collect()}
    sum_want = {r["id"]: r["s"] for r in df.withColumn("s", F.sum("v").over(ws)).collect()}
    # month buckets with at most 20 rows: most buckets are cut into seconds
    lag_got = {r["id"]: r["p"] for r in previous_value(df, "ts", "v", "p", "g", "id", "month", hot_rows=20).collect()}
    sum_got = {r["id"]: r["s"] for r in running_sum(df, "ts", "v", "s", "g", "id", "month", hot_rows=20).collect()}
    assert lag_got == lag_want and sum_got == sum_want


def test_replay_schedule_hot_split_equal(spark):
    from cabline.functions.timeparts import with_calendar
    from cabline.operators.replay import replay_schedule
    from cabline.schema import TRIP_COLUMNS
    from cabline.sources import bindings as B
    from tests.conftest import SF_SMALL

    t = with_calendar(B.trips(spark, SF_SMALL))
    tie = [c for c in TRIP_COLUMNS if c != "tpep_pickup_datetime"]
    cols = ["gap_seconds", "wait_seconds", "send_offset_seconds"] + list(TRIP_COLUMNS)
    a = replay_schedule(t, tiebreak=tie).select(*cols)
    b = replay_schedule(t, tiebreak=tie, bucket_unit="month", hot_rows=5).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
