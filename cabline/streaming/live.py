"""Live sink: running total, next-hour forecast and real-time messages
(T5, T6, T9, K4, K8, A4, A5, A8, W4).

State lives in small Parquet tables in the shared folder, one partition per
``batch_id``, of which the newest few are kept. A replayed micro-batch
recomputes its rows from the state before it and overwrites its own
partition, so results are exactly once even when executors or the driver are
lost. Everything that depends on time is computed as columns, in the
session's zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from cabline.functions.timeparts import hour_start
from cabline.operators.analytics import live_counts
from cabline.operators.forecast import score_next_hour, serving_features
from cabline.operators.joins import enrich_zones
from cabline.operators.timeline import timeline_points, upsert_points
from cabline.schema import RUNNING_TOTAL_TTL_SECONDS
from cabline.session import child_names, path_exists, remove_path

STATE_SCHEMA = StructType(
    [
        StructField("batch_id", LongType(), False),
        StructField("total", LongType(), False),
        StructField("hour", TimestampType(), True),
        StructField("hour_count", LongType(), False),
        StructField("max_pickup_time", TimestampType(), True),
        StructField("batch_trip_count", LongType(), False),
        StructField("updated_at", TimestampType(), False),
    ]
)


#: State partitions kept: the last one, and those before it in case a batch is replayed.
KEPT_STATES = 3


def _write_batch_partition(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def _batch_ids(spark: SparkSession, path: str, name: str = "batch_id") -> list[int]:
    return sorted(int(n.split("=")[1]) for n in child_names(spark, path) if n.startswith(f"{name}="))


def _previous_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state row of batch ``batch_id - 1``, or None if no batch before
    this one has written any. A state that can't be read, has a gap or runs
    ahead of this batch (another query's) fails: the total never restarts
    unnoticed."""
    ids = _batch_ids(spark, path)
    if any(i > batch_id for i in ids):
        raise ValueError(f"{path} has state of batch {ids[-1]}, after batch {batch_id}: it belongs to another checkpoint")
    if not [i for i in ids if i < batch_id]:
        return None
    return spark.read.schema(STATE_SCHEMA).parquet(f"{path.rstrip('/')}/batch_id={batch_id - 1}").drop("batch_id")


class LiveSink:
    """``foreachBatch`` handler.

    Per non-empty batch: latest pickup, row count and the count of the
    current clock hour (one aggregation), the new running total (reset after
    ``ttl_seconds`` without updates, T5), the forecast for the next hour
    (T6) and one message (K8). An empty batch carries the state forward and
    sends no message. ``now``: a function that gives the UTC time, for
    tests."""

    def __init__(self, state_path: str, messages_path: str, model=None,
                 ts: str = "tpep_pickup_datetime", ttl_seconds: int = RUNNING_TOTAL_TTL_SECONDS,
                 now=None):
        self.state_path = state_path
        self.messages_path = messages_path
        self.model = model
        self.ts = ts
        self.ttl_seconds = ttl_seconds
        self.now = now

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        spark, batch_id = batch_df.sparkSession, int(batch_id)
        prev = _previous_state(spark, self.state_path, batch_id)
        _write_batch_partition(self.state(batch_df, prev, batch_id), self.state_path)
        written = f"{self.state_path.rstrip('/')}/batch_id={batch_id}"
        if path_exists(spark, written):  # else empty batches before the first row
            state = spark.read.schema(STATE_SCHEMA).parquet(written).withColumn("batch_id", F.lit(batch_id).cast("long"))
            _write_batch_partition(self.message(state.where("batch_trip_count > 0")), self.messages_path)
        for old in _batch_ids(spark, self.state_path)[:-KEPT_STATES]:
            remove_path(spark, f"{self.state_path.rstrip('/')}/batch_id={old}")

    def state(self, batch_df: DataFrame, prev: DataFrame | None, batch_id: int) -> DataFrame:
        """The one state row after this batch, or none without any trip so far."""
        ts = F.col(self.ts)
        now = F.current_timestamp() if self.now is None else F.lit(self.now().isoformat() + "Z").cast("timestamp")
        hours = batch_df.groupBy(hour_start(ts).alias("h")).agg(F.max(ts).alias("m"), F.count(F.lit(1)).alias("n"))
        stats = hours.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("m").alias("m"), F.max("h").alias("h"), F.max_by("n", "h").alias("h_n")
        ).withColumn("now", now)
        if prev is None:
            prev = batch_df.sparkSession.createDataFrame([], STATE_SCHEMA).drop("batch_id")
        s = stats.withColumn("one", F.lit(1)).join(prev.withColumn("one", F.lit(1)), "one", "left")
        alive = F.coalesce(F.col("updated_at") >= F.col("now") - F.make_dt_interval(secs=F.lit(self.ttl_seconds)), F.lit(False))
        some = F.col("n") > 0
        same_hour = F.coalesce(alive & (F.col("hour") == F.col("h")), F.lit(False))
        return s.where(some | F.col("total").isNotNull()).select(
            F.lit(batch_id).cast("long").alias("batch_id"),
            F.when(some, F.when(alive, F.col("total")).otherwise(0) + F.col("n")).otherwise(F.col("total")).alias("total"),
            F.when(some, F.col("h")).otherwise(F.col("hour")).alias("hour"),
            F.when(some, F.col("h_n") + F.when(same_hour, F.col("hour_count")).otherwise(0)).otherwise(F.col("hour_count")).alias("hour_count"),
            F.when(some, F.col("m")).otherwise(F.col("max_pickup_time")).alias("max_pickup_time"),
            F.col("n").alias("batch_trip_count"),
            F.when(some, F.col("now")).otherwise(F.col("updated_at")).alias("updated_at"),
        )

    def message(self, state: DataFrame) -> DataFrame:
        """K8 columns (+ batch_id); predicted count = total + truncated
        prediction (P17), or null without a model."""
        return score_next_hour(self.model, serving_features(state, "max_pickup_time", "hour_count"), "total", keep=("batch_id",))


class TimelineSink:
    """``foreachBatch`` handler that upserts real-time messages into the
    stored timeline (T9): each batch gives a new version of the table, one
    row per timestamp, from the last version and the batch's points. A
    replayed batch writes its own version again from the one before."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        spark = batch_df.sparkSession
        points = timeline_points(batch_df)
        older = [v for v in _versions(spark, self.path) if v < batch_id]
        if older:
            points = points.unionByName(spark.read.parquet(f"{self.path}/version={older[-1]}"))
        _write_version(upsert_points(points), self.path, int(batch_id))


def running_total_query_frame(valid: DataFrame, ts: str = "tpep_pickup_datetime") -> DataFrame:
    """T5 without expiry as a built-in stateful aggregation: one state row,
    partial counts per task before the shuffle; emit with ``update`` mode."""
    return valid.withColumn("k", F.lit("total_trips")).groupBy("k").agg(
        F.count(F.lit(1)).alias("total"), F.max(ts).alias("max_pickup_time")
    )


def live_counts_frame(valid: DataFrame, zones: DataFrame, dim: str = "pickup_borough") -> DataFrame:
    """A8 on the stream: stream-static join with the (size-checked,
    broadcast) zone dimension, then a running count per ``dim``."""
    return live_counts(enrich_zones(valid, zones), dim)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of a table, oldest first."""
    return [v for v in _batch_ids(spark, path, "version") if path_exists(spark, f"{path}/version={v}/_SUCCESS")]


def _write_version(df: DataFrame, path: str, version: int) -> None:
    """Write a version beside the ones that readers may have open, then drop all but the last two."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    for old in _versions(spark, path)[:-2]:
        remove_path(spark, f"{path}/version={old}")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table kept by ``overwrite_sink`` or ``TimelineSink``."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no complete version below {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def overwrite_sink(path: str):
    """``foreachBatch`` handler for ``complete`` mode results: each batch
    is a version of the table (idempotent); ``read_latest`` reads it."""

    def write(batch_df: DataFrame, batch_id: int) -> None:
        _write_version(batch_df, path, int(batch_id))

    return write


def top_k(df: DataFrame, k: int = 10, by: str = "trip_count", tie: str | None = None) -> DataFrame:
    """Top of the live counts (``TakeOrderedAndProject``), ties by ``tie``."""
    order = [F.col(by).desc()] + ([F.col(tie).asc_nulls_first()] if tie else [])
    return df.orderBy(*order).limit(k)
