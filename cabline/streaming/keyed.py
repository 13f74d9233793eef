"""Keyed state held by Spark's own state store.

The running total with idle expiry is a count over session windows of the
trips' arrival: a session goes on as long as the next trips come within the
expiry, and the total of the last session is the running total. The timeline
is one state row per timestamp, aggregated in update mode, so a micro-batch
emits the points that it touches and no others. Both are built-in stateful
aggregations: state lives in the RocksDB state store, is partitioned by key,
survives a restart through the query's checkpoint, and rows are combined per
task before the shuffle. What a batch emits is written idempotently as a
partition of a log, which ``read_log`` folds.

Python state functions (``transformWithStateInPandas``) aren't used: with
PySpark 4.1.2 here their workers and the JVM wait for each other forever.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.operators.timeline import timeline_points, upsert_points
from cabline.schema import RUNNING_TOTAL_TTL_SECONDS

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # sessions are merged in each task first, so the one key gets a few rows a task
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # else each store of a partition takes megabytes of disk before it holds a row
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
POINT_COLUMNS = "ts timestamp, trip_count long, trip_seq long, predicted_trip_count long, predicted_seq long"


@contextmanager
def state_settings(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's settings stay as they were."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def running_totals(valid: DataFrame, ts: str = "tpep_pickup_datetime", ttl_seconds: int = RUNNING_TOTAL_TTL_SECONDS, arrival: Column | None = None) -> DataFrame:
    """T5 + A4 on a stream of valid trips, for complete mode: one row per
    session of arrivals without a pause of ``ttl_seconds``: its first and last
    arrival, the trips so far and their latest pickup.

    ``arrival``: by default the time of the micro-batch, which Spark logs with
    its offsets, so a replayed batch falls into the same session."""
    arrived = F.current_timestamp() if arrival is None else arrival
    rows = valid.select(F.lit("total_trips").alias("k"), arrived.alias("arrival"), F.col(ts).alias("pickup"))
    total = rows.groupBy("k", F.session_window("arrival", f"{ttl_seconds} seconds").alias("session")).agg(
        F.count(F.lit(1)).alias("total"), F.max("pickup").alias("max_pickup_time"), F.max("arrival").alias("last_arrival")
    )
    return total.select("k", F.col("session.start").alias("first_arrival"), "last_arrival", "total", "max_pickup_time")


def running_total(sessions: DataFrame) -> DataFrame:
    """The running total: that of the last session, unless it has expired by then."""
    return sessions.orderBy(F.col("first_arrival").desc()).limit(1)


def timeline_changes(messages: DataFrame) -> DataFrame:
    """T9 on a stream of real-time messages, for update mode: the points that
    a micro-batch touches, as they are after it (last write wins per side)."""
    return upsert_points(timeline_points(messages))


class ChangeLog:
    """``foreachBatch`` handler: a batch's rows as partition ``batch_id`` of a log; a replayed batch overwrites its own."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        batch_df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batch_id={int(batch_id)}")


def read_log(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The log folded: the last change of each key."""
    log = spark.read.schema(f"{schema}, batch_id long").parquet(path)
    columns = [c for c in log.columns if c not in (key, "batch_id")]
    last = log.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("last"))
    return last.select(key, "last.*")
