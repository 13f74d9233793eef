"""Hours closed by the watermark, and what comes after."""

import datetime as dt

from cabline.streaming import hourly as HS
from cabline.streaming.keyed import ChangeLog


def _take(spark, base, hours):
    """The next messages, in a run of its own."""
    at = [(dt.datetime(2024, 1, 1 + h // 24, h % 24, 30) if h is not None else None,) for h in hours]
    spark.createDataFrame(at, "tpep_pickup_datetime timestamp").coalesce(1).write.mode("append").json(f"{base}/topic")
    stream = spark.readStream.schema("tpep_pickup_datetime timestamp").option("maxFilesPerTrigger", 1).json(f"{base}/topic")
    for q in HS.start_hourly(stream, f"{base}/hours", f"{base}/ck", lateness="2 hours", available_now=True):
        q.awaitTermination()
        assert q.exception() is None
    return {r.pickup_hour.hour + 24 * (r.pickup_hour.day - 1): (r.trip_count, r.late) for r in HS.read_hours(spark, f"{base}/hours").collect()}


def test_closed_hours_and_late_trips(spark, tmp_dir):
    assert _take(spark, tmp_dir, [0, 0, 1, 2]) == {}  # watermark 0:30, no hour has ended before it
    assert _take(spark, tmp_dir, [1, 4, None]) == {0: (2, 0), 1: (2, 0)}  # watermark 2:30; a trip without time is in no hour
    # after the watermark: one hour again, one that had none; hour 2 is open and takes its trip
    assert _take(spark, tmp_dir, [0, 1, 1, 2]) == {0: (2, 1), 1: (2, 2)}
    assert _take(spark, tmp_dir, [30]) == {0: (2, 1), 1: (2, 2), 2: (2, 0), 4: (1, 0)}
    assert _take(spark, tmp_dir, [3]) == {0: (2, 1), 1: (2, 2), 2: (2, 0), 3: (0, 1), 4: (1, 0)}


def test_repeated_batch_counts_once(spark, tmp_dir):
    log = ChangeLog(f"{tmp_dir}/closed")
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), 5)], "pickup_hour timestamp, trip_count long")
    for _ in range(2):
        log(rows, 7)
        ChangeLog(f"{tmp_dir}/seen")(rows, 3)
    assert [(r.trip_count, r.late) for r in HS.read_hours(spark, tmp_dir).collect()] == [(5, 0)]
