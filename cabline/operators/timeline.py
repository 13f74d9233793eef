"""Live timeline: message feed, keyed upsert, actual/predicted merge, chart
window, tick grid and bridge point.

The dashboard keeps a timeline keyed by timestamp: each real-time message
upserts the actual count at its timestamp and the predicted count at its
predicted timestamp (last write wins). The chart shows +-1 hour around the
latest actual point. All of it is expressed as aggregations and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabline.functions.timeparts import message_time, plus_hours, plus_minutes
from cabline.operators.ordered import running_sum
from cabline.schema import MESSAGE_TIME_PATTERN, TIMELINE_HALF_WINDOW_MINUTES, TIMELINE_TICK_MINUTES


def micro_batches(df: DataFrame, ts: str, seconds: int = 900) -> DataFrame:
    """A4 + A5 per fixed event-time batch: ``seq`` (batch start, unix
    seconds), latest timestamp and row count. Partial aggregation first."""
    seq = F.floor(F.unix_micros(F.col(ts)) / F.lit(seconds * 1_000_000)) * F.lit(seconds)
    return df.groupBy(seq.alias("seq")).agg(
        F.max(ts).alias("max_pickup_time"), F.count(F.lit(1)).alias("batch_trip_count")
    )


def message_feed(df: DataFrame, ts: str, seconds: int = 900, rate_hours: float = 1.0) -> DataFrame:
    """The real-time message stream as data (K8 columns plus ``seq``).

    ``trip_count`` is the running total over batches (W4). The predicted
    count at +1 hour extrapolates the batch rate to one hour (a model-free
    stand-in; the model-based message is ``forecast.score_next_hour``)."""
    b = micro_batches(df, ts, seconds)
    b = running_sum(b.withColumn("_seq_ts", F.timestamp_seconds("seq")), "_seq_ts", "batch_trip_count",
                    "trip_count", bucket_unit="day", hot_rows=None)  # one row per batch
    per_hour = int(round(3600 * rate_hours / seconds))
    return b.select(
        "seq",
        message_time("max_pickup_time").alias("timestamp"),
        F.col("trip_count").cast("bigint").alias("trip_count"),
        message_time(plus_hours("max_pickup_time", 1)).alias("predicted_timestamp"),
        (F.col("trip_count") + F.col("batch_trip_count") * per_hour).cast("bigint").alias("predicted_trip_count"),
    )


def _parse(c: str) -> Column:
    return F.try_to_timestamp(F.col(c), F.lit(MESSAGE_TIME_PATTERN))


def last_write(df: DataFrame, key: Column, value: str, seq: str, out: str) -> DataFrame:
    """Per key, the value of the latest message (highest ``seq``)."""
    return df.groupBy(key.alias("ts")).agg(F.max_by(F.col(value), F.col(seq)).alias(out))


def merge_timeline(feed: DataFrame) -> DataFrame:
    """J3 (+ W5 on both sides): ``ts, trip_count, predicted_trip_count``;
    the side without a point at a timestamp is null. A message whose time
    does not parse gives no point on that side (``bad_messages`` has it)."""
    actual = last_write(feed, _parse("timestamp"), "trip_count", "seq", "trip_count")
    predicted = last_write(feed, _parse("predicted_timestamp"), "predicted_trip_count", "seq", "predicted_trip_count")
    actual, predicted = (x.where(F.col("ts").isNotNull()) for x in (actual, predicted))
    return actual.join(predicted, on="ts", how="full_outer")


def bad_messages(feed: DataFrame) -> DataFrame:
    """Messages with a time text that does not parse, for quarantine."""
    bad = [F.col(c).isNotNull() & _parse(c).isNull() for c in ("timestamp", "predicted_timestamp")]
    return feed.where(bad[0] | bad[1])


def last_actual(feed: DataFrame) -> DataFrame:
    """L7 from the messages: ``ts, trip_count`` of the latest actual point
    (last write wins), or no row. One aggregation; no timeline is built."""
    top = feed.select(_parse("timestamp").alias("ts"), "trip_count", "seq").where("ts is not null and trip_count is not null")
    best = top.agg(F.max(F.struct("ts", "seq", "trip_count")).alias("p")).where("p is not null")
    return best.select("p.ts", "p.trip_count")


def timeline_points(feed: DataFrame) -> DataFrame:
    """Each message as its points: ``ts`` with the actual or the predicted
    count and the ``seq`` that wrote it."""
    none = F.lit(None).cast("long")
    actual = feed.select(_parse("timestamp").alias("ts"), "trip_count", F.col("seq").alias("trip_seq"),
                         none.alias("predicted_trip_count"), none.alias("predicted_seq"))
    predicted = feed.select(_parse("predicted_timestamp").alias("ts"), none.alias("trip_count"), none.alias("trip_seq"),
                            "predicted_trip_count", F.col("seq").alias("predicted_seq"))
    return actual.unionByName(predicted).where(F.col("ts").isNotNull())


def upsert_points(points: DataFrame) -> DataFrame:
    """W5 on both sides at once: one row per ``ts``, the last write of each side wins."""
    return points.groupBy("ts").agg(
        F.max_by("trip_count", "trip_seq").alias("trip_count"), F.max("trip_seq").alias("trip_seq"),
        F.max_by("predicted_trip_count", "predicted_seq").alias("predicted_trip_count"), F.max("predicted_seq").alias("predicted_seq"),
    )


def latest_actual(timeline: DataFrame) -> DataFrame:
    """One row, ``m`` = latest timestamp with an actual count."""
    return timeline.filter(F.col("trip_count").isNotNull()).agg(F.max("ts").alias("m"))


def chart_window(timeline: DataFrame, minutes: int = TIMELINE_HALF_WINDOW_MINUTES) -> DataFrame:
    """F10 + F12 + P21 + L5: points within +-1 hour (inclusive) of the
    latest actual one, tagged actual / predicted, ordered by time. The
    latest time enters as a scalar subquery."""
    m = latest_actual(timeline).select("m").scalar()
    lo, hi = plus_minutes(m, -minutes), plus_minutes(m, minutes)
    w = timeline.filter(F.col("ts").between(lo, hi))
    w = w.filter(F.col("trip_count").isNotNull() | F.col("predicted_trip_count").isNotNull())
    kind = F.when(F.col("ts") > m, F.lit("predicted")).otherwise(F.lit("actual"))
    return w.withColumn("point_kind", kind).orderBy("ts")


def bridge(window: DataFrame) -> DataFrame:
    """The predicted series starts at the last actual point, so there the
    predicted value is the actual one."""
    m = window.filter(F.col("trip_count").isNotNull()).agg(F.max("ts")).scalar()
    return window.withColumn(
        "predicted_trip_count",
        F.when(F.col("ts") == m, F.col("trip_count")).otherwise(F.col("predicted_trip_count")),
    )


def time_grid(anchor: DataFrame, minutes: int = TIMELINE_HALF_WINDOW_MINUTES,
              step_minutes: int = TIMELINE_TICK_MINUTES) -> DataFrame:
    """G1: ticks every ``step`` over ``[m - 1h, m + 1h)`` for each anchor row
    ``m`` (end excluded: ``sequence`` includes its end, so it stops one
    step early)."""
    start = plus_minutes("m", -minutes)
    stop = plus_minutes("m", minutes - step_minutes)
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(step_minutes))
    return anchor.filter(F.col("m").isNotNull()).select(F.explode(F.sequence(start, stop, step)).alias("tick"))
