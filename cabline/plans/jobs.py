"""End-to-end jobs: the monthly batch, the model retrain and the streaming
ingest, each a composition of the operators in this package.

Paths are roots in shared storage; every write is repeatable (re-running a
month or restarting a stream does not duplicate rows).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.operators import forecast as FC
from cabline.plans import batch
from cabline.sinks import tables as K
from cabline.sources.tables import load_model
from cabline.sources.trips import read_processed, read_valid
from cabline.sources.zones import read_zones
from cabline.streaming import control, ingest, live


@dataclass
class BatchPaths:
    raw_valid: str  # streaming valid store, partitioned year/month/day/hour
    zones_csv: str
    processed: str  # processed trips, partitioned year/month
    fact_trips: str  # latest month only
    analyze_by_time: str  # partitioned year/month
    analyze_by_routes: str  # partitioned year/month


def monthly_batch(spark: SparkSession, paths: BatchPaths, year: int, month: int, jdbc: dict | None = None) -> dict:
    """Entry B: one month of valid trips -> zones, measures, outlier bounds
    -> processed store, fact table and both aggregate tables.

    The processed month is persisted once (four outputs read it) and written
    by dynamic partition overwrite, so a retried run replaces the month."""
    valid = read_valid(spark, paths.raw_valid, year, month).drop("day", "hour")
    processed = batch.process(valid, read_zones(spark, paths.zones_csv)).persist()
    try:
        by_time, by_routes = batch.aggregates(processed)
        run = {"year": year, "month": month}
        K.write_month(processed, paths.processed, run)
        K.write_table(processed, paths.fact_trips, mode="overwrite", jdbc=_table(jdbc, "fact_trips"))
        K.replace_partitions(by_time, paths.analyze_by_time, requested=run, jdbc=_table(jdbc, "analyze_by_time"))
        K.replace_partitions(by_routes, paths.analyze_by_routes, requested=run, jdbc=_table(jdbc, "analyze_by_routes"))
        return {"processed_rows": processed.count()}
    finally:
        processed.unpersist()


def _table(jdbc: dict | None, name: str) -> dict | None:
    return dict(jdbc, table=name) if jdbc else None


def retrain(spark: SparkSession, processed_root: str, model_path: str, gap: str = "grid", **kw):
    """Model job: hourly series of the whole processed history (only the
    pickup column is read), labelled, fitted and saved (overwrite)."""
    history = read_processed(spark, processed_root).select("tpep_pickup_datetime")
    train = FC.add_label(FC.hourly_series(history), gap=gap)
    model = FC.fit_forecast(train, **kw)
    K.save_model(model, model_path)
    return model


@dataclass
class StreamPaths:
    raw_valid: str
    raw_error: str
    state: str
    messages: str
    checkpoints: str


def streaming_ingest(
    spark: SparkSession,
    source: ingest.StreamSource,
    paths: StreamPaths,
    model_path: str | None = None,
    storage_trigger: str = "10 seconds",
    live_trigger: str = "3 seconds",
    available_now: bool = False,
    idle_polls: int | None = None,
    poll_seconds: float = 10,
):
    """Entry A: parse -> split -> valid / error stores and the live sink,
    three queries with their own checkpoints. With ``idle_polls`` the call
    blocks and stops everything after that many idle polls (T7)."""
    parsed = ingest.parse_stream(ingest.read_trip_stream(spark, source))
    valid, error = ingest.split_stream(parsed)
    root = paths.checkpoints.rstrip("/")
    qv = ingest.start_parquet_sink(valid, paths.raw_valid, f"{root}/valid", trigger=storage_trigger,
                                   available_now=available_now)
    qe = ingest.start_parquet_sink(error, paths.raw_error, f"{root}/error", trigger=storage_trigger,
                                   available_now=available_now)
    model = load_model(model_path) if model_path else None
    ql = ingest.start_foreach_batch(valid, live.LiveSink(paths.state, paths.messages, model=model),
                                    f"{root}/live", trigger=live_trigger, available_now=available_now)
    queries = [qv, qe, ql]
    if idle_polls is not None:
        control.stop_when_idle(queries, watched=[ql, qv], polls=idle_polls, every=poll_seconds)
    return queries


def running_total(spark: SparkSession, state_path: str) -> DataFrame:
    """The latest running total kept by the live sink."""
    st = spark.read.parquet(state_path)
    return st.orderBy(F.col("batch_id").desc()).limit(1).select("total", "max_pickup_time", "updated_at")
