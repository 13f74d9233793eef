"""The hourly series kept up by a stream.

An hour's count is emitted once, when the watermark has passed the hour's end:
a tumbling window in append mode, whose state is one row per open hour. Trips
that arrive for an hour already closed are dropped there by the watermark, but
not lost: a second count without watermark has one row per hour, 87,000 in ten
years, and takes every trip. What it has more of a closed hour came late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cabline.operators.analytics import hourly_counts
from cabline.streaming.ingest import start_foreach_batch
from cabline.streaming.keyed import ChangeLog, read_log, state_settings

LATENESS = "1 day"


def closed_hours(trips: DataFrame, ts: str = "tpep_pickup_datetime", lateness: str = LATENESS) -> DataFrame:
    """For append mode: ``pickup_hour, trip_count`` of hours that ended ``lateness`` before the latest trip seen."""
    counts = trips.withWatermark(ts, lateness).groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("trip_count"))
    return counts.select(F.col("w.start").alias("pickup_hour"), "trip_count")


def start_hourly(
    trips: DataFrame,
    path: str,
    checkpoint: str,
    ts: str = "tpep_pickup_datetime",
    lateness: str = LATENESS,
    trigger: str | None = "1 minute",
    available_now: bool = False,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Both counts as queries of their own. A trip without time belongs to no hour.

    Closed hours and the log of all hours are written per micro-batch; a
    replayed batch overwrites what it wrote. Restart with the same checkpoint."""
    path, checkpoint = path.rstrip("/"), checkpoint.rstrip("/")
    timed = trips.where(F.col(ts).isNotNull())
    every = hourly_counts(timed, ts)
    with state_settings(trips.sparkSession):
        closed = start_foreach_batch(closed_hours(timed, ts, lateness), ChangeLog(f"{path}/closed"), f"{checkpoint}/closed", trigger, available_now)
        seen = start_foreach_batch(every, ChangeLog(f"{path}/seen"), f"{checkpoint}/seen", trigger, available_now, output_mode="update")
    return closed, seen


def read_hours(spark, path: str) -> DataFrame:
    """``pickup_hour, trip_count, late``: every hour up to the newest closed
    one, the trips counted when it closed (0 if all of them came late) and
    those that came after. Later hours are open and not listed. The two queries
    run apart: while the second lags behind, ``late`` is less, never negative."""
    path = path.rstrip("/")
    closed = read_log(spark, f"{path}/closed", "pickup_hour", "pickup_hour timestamp, trip_count long")
    seen = read_log(spark, f"{path}/seen", "pickup_hour", "pickup_hour timestamp, trip_count long").withColumnRenamed("trip_count", "n")
    newest = closed.agg(F.max("pickup_hour").alias("newest"))
    both = seen.join(closed, "pickup_hour", "full").join(F.broadcast(newest), F.col("pickup_hour") <= F.col("newest"))
    on_time = F.coalesce("trip_count", F.lit(0))
    return both.select("pickup_hour", on_time.alias("trip_count"), F.greatest(F.coalesce("n", F.lit(0)) - on_time, F.lit(0)).alias("late"))
