"""Replay of trip records as a paced, keyed message stream.

The upstream replayer pages through one month of trips in pickup order,
sleeps ``min(gap / speed, cap)`` between records and sends each record as
JSON keyed by its pickup location. Here the schedule is data: each record
gets its gap to the previous record and its send offset (running sum of
waits), computed per replay unit (taxi type / month) in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.operators.ordered import HOT_ROWS, with_buckets
from cabline.operators.rules import calendar_filter
from cabline.schema import (
    DEFAULT_MESSAGE_KEY,
    ISO_SECONDS_PATTERN,
    REPLAY_CAP_SECONDS,
    REPLAY_SPEED,
    TOPIC_PATTERN,
    TRIP_SCHEMA,
)


def replay_schedule(
    df: DataFrame,
    ts: str = "tpep_pickup_datetime",
    partition_by=("year", "month"),
    tiebreak=None,
    speed: float = REPLAY_SPEED,
    cap: float = REPLAY_CAP_SECONDS,
    bucket_unit: str = "hour",
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """W2 + W3: ``gap_seconds`` to the previous record of the replay unit
    (null for the first), ``wait_seconds = min(gap / speed, cap)`` (0 for
    the first) and ``send_offset_seconds`` = running sum of waits.

    One window pass per (unit, time bucket) computes the in-bucket lag,
    waits and their running sum; one per-bucket summary (first and last
    time, in-bucket wait total; one row per bucket) gives each bucket the
    last time of the bucket before it and the waits of all earlier buckets.
    The summary needs the times alone, as rows of the same time wait equally
    in any order, so whole rows are shuffled once: for their window, whose
    key the summary's join shares (a struct, in which a null equals a null).
    No window spans a whole unit of raw rows; a bucket of more than
    ``hot_rows`` rows is cut into one-second buckets."""
    keys = list(partition_by or [])
    order = [ts] + list(tiebreak or [])
    t = F.col(ts)

    def secs(a, b):
        return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1_000_000)

    def wait_of(gap):
        # least() skips nulls: without a record before it, there is no wait
        return F.when(gap.isNotNull(), F.least(gap / F.lit(speed), F.lit(float(cap))))

    x = with_buckets(df, ts, keys, bucket_unit, hot_rows)

    def paced(rows, w):
        rows = rows.withColumn("_lag", F.lag(ts).over(w)).withColumn("_pos", F.row_number().over(w))
        return rows.withColumn("_w", F.when(F.col("_pos") > 1, wait_of(secs(t, F.col("_lag")))).otherwise(F.lit(0.0)))

    key = F.struct(*keys, "_bk").alias("_k")
    times = paced(x.select(*dict.fromkeys([*keys, "_bk", ts])), Window.partitionBy(*keys, "_bk").orderBy(ts))
    w = Window.partitionBy("_k").orderBy(*order)
    x = paced(x.select("*", key), w)
    x = x.withColumn("_cum", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    wb = Window.partitionBy(*keys).orderBy("_bk")
    summary = (
        times.groupBy(*keys, "_bk")
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.sum("_w").alias("_inb"))
        .withColumn("_carry", F.lag("_last").over(wb))
        .withColumn("_fw", F.coalesce(wait_of(secs(F.col("_first"), F.col("_carry"))), F.lit(0.0)))
        .withColumn("_off", F.coalesce(
            F.sum(F.col("_fw") + F.col("_inb")).over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .select(key, "_carry", "_fw", "_off")
    )
    x = x.join(summary, "_k", "left").select(*x.columns, "_carry", "_fw", "_off")
    first = F.col("_pos") == 1
    return x.withColumns(
        {
            "gap_seconds": F.when(first, secs(t, F.col("_carry"))).otherwise(secs(t, F.col("_lag"))),
            "wait_seconds": F.when(first, F.col("_fw")).otherwise(F.col("_w")),
            "send_offset_seconds": F.col("_off") + F.col("_fw") + F.col("_cum"),
        }
    ).drop("_k", "_bk", "_lag", "_pos", "_w", "_cum", "_carry", "_fw", "_off")


def ordered_messages(df: DataFrame, year: int, month: int, ts: str = "tpep_pickup_datetime", tiebreak=None,
                     taxi_type: str = "yellow", **schedule) -> DataFrame:
    """L8 as one plan: the month's trips (F4), in pickup order with the send
    offset of each (W3), as keyed messages (K1) to be sent in that order."""
    trips = calendar_filter(df, ts, year, month)
    cols = trips.columns
    paced = replay_schedule(trips, ts, (), tiebreak, **schedule).select(*cols, "send_offset_seconds")
    return to_messages(paced, taxi_type=taxi_type, carry=("send_offset_seconds",)).orderBy("send_offset_seconds", "key", "value")


def to_messages(
    df: DataFrame,
    key_col: str = "PULocationID",
    taxi_type: str | None = "yellow",
    timestamp_format: str = ISO_SECONDS_PATTERN,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """K1: ``(topic, key, value)`` with ``value`` the JSON of the whole row
    and ``key`` the pickup location as text (``default`` when absent).
    Columns in ``carry`` stay columns beside the message."""
    cols = [c for c in df.columns if c not in carry]
    value = F.to_json(F.struct(*cols), {"timestampFormat": timestamp_format})
    out = df.select(
        F.coalesce(F.col(key_col).cast("string"), F.lit(DEFAULT_MESSAGE_KEY)).alias("key"),
        value.alias("value"),
        *carry,
    )
    if taxi_type is not None:
        out = out.withColumn("topic", F.lit(TOPIC_PATTERN.format(taxi_type=taxi_type)))
    return out


def decode_messages(
    df: DataFrame,
    schema=TRIP_SCHEMA,
    value_col: str = "value",
    keep_raw: bool = True,
) -> DataFrame:
    """S4 + P22: value (bytes or text) -> fixed-schema struct -> flat columns.

    Timestamps are read by the default parser, which takes the ISO form that
    ``to_messages`` writes as well as fractions of a second and a blank in
    place of the ``T``. Malformed JSON or a null value give all-null fields, not errors; those
    rows fail the validity rules and land in quarantine. ``_raw`` keeps the
    original text for dead letters. The text is parsed once a row: out of a
    projection, each rule on a column would parse it again."""
    text = F.col(value_col).cast("string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return df.select(F.inline(F.array(parsed)), *([text.alias("_raw")] if keep_raw else []))
