"""Streaming ingest: message source, parse, split and the storage sinks
(S3, S4, T1-T4, T10, K2, K3).

One parsed stream feeds independent queries (valid store, error store, live
sink), each with its own checkpoint. No watermark: a late record is simply
appended to its own hour's partition (T10).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cabline.operators.replay import decode_messages
from cabline.operators.rules import split_valid
from cabline.plans.ingest import prepare
from cabline.schema import PARTITION_COLUMNS, TOPIC_PATTERN
from cabline.streaming.message_log import FORMAT, PARTITIONS, log_rows, register_log


@dataclass
class StreamSource:
    """Where the trip messages come from.

    ``format="kafka"`` subscribes to ``{taxi_type}_trip_data`` (needs the
    Kafka connector on the classpath); ``format="text"`` / ``"json"`` reads
    message files from ``path`` with the same ``value`` column (``json``: the
    ``key``/``value`` lines of ``sinks.messages``). ``format="log"`` reads the
    message log at ``path`` by offsets like the broker's; ``position`` is a
    folder beside the query's checkpoint. Other formats fail."""

    format: str = "kafka"
    taxi_type: str = "yellow"
    bootstrap_servers: str | None = None
    path: str | None = None
    starting_offsets: str = "latest"
    fail_on_data_loss: bool = False
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int | None = None  # batches follow the bytes, not the number of files
    max_offsets_per_trigger: int | None = None  # not with availableNow, which takes one batch
    position: str | None = None


def read_trip_stream(spark: SparkSession, src: StreamSource) -> DataFrame:
    """S3 + T4."""
    if src.format == "kafka":
        r = (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", src.bootstrap_servers)
            .option("subscribe", TOPIC_PATTERN.format(taxi_type=src.taxi_type))
            .option("startingOffsets", src.starting_offsets)
            .option("failOnDataLoss", str(src.fail_on_data_loss).lower())
        )
        if src.max_offsets_per_trigger:
            r = r.option("maxOffsetsPerTrigger", src.max_offsets_per_trigger)
        return r.load()
    if src.format == "log":
        register_log(spark)
        r = spark.readStream.format(FORMAT).option("startingOffsets", src.starting_offsets).option("position", src.position)
        r = r.option("failOnDataLoss", str(src.fail_on_data_loss).lower()).option("maxOffsetsPerTrigger", src.max_offsets_per_trigger or 0)
        return r.load(src.path)
    if src.format == "text":
        r = spark.readStream.format("text")
    elif src.format == "json":
        r = spark.readStream.format("json").schema("key string, value string")
    else:
        raise ValueError(f"unknown source format {src.format!r}")
    if src.max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", src.max_files_per_trigger)
    if src.max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", src.max_bytes_per_trigger)
    return r.load(src.path)


def parse_stream(raw: DataFrame, keep_raw: bool = True) -> DataFrame:
    """S4 + P22 + P1 + P2: value -> trip columns -> calendar parts -> defaults."""
    return prepare(decode_messages(raw, keep_raw=keep_raw))


def split_stream(parsed: DataFrame, null_policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """F1 + F2 on the stream. ``_raw`` stays on the error side only."""
    valid, error = split_valid(parsed, null_policy=null_policy)
    if "_raw" in valid.columns:
        valid = valid.drop("_raw")
    return valid, error


def _trigger(writer, trigger: str | None, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger) if trigger else writer


def start_parquet_sink(
    df: DataFrame,
    path: str,
    checkpoint: str,
    partition_cols=PARTITION_COLUMNS,
    trigger: str | None = "10 seconds",
    available_now: bool = False,
    query_name: str | None = None,
) -> StreamingQuery:
    """K2 / K3 (+ T2, T3): append Parquet partitioned by calendar parts with
    its own checkpoint; the file sink's log makes output exactly once."""
    w = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .partitionBy(*partition_cols)
    )
    if query_name:
        w = w.queryName(query_name)
    return _trigger(w, trigger, available_now).start()


def start_foreach_batch(
    df: DataFrame,
    fn,
    checkpoint: str,
    trigger: str | None = "3 seconds",
    available_now: bool = False,
    output_mode: str = "append",
    query_name: str | None = None,
) -> StreamingQuery:
    """K4: per-micro-batch sink. ``fn(batch_df, batch_id)`` must be
    idempotent on ``batch_id`` (a batch is replayed after a failure)."""
    w = df.writeStream.foreachBatch(fn).outputMode(output_mode).option("checkpointLocation", checkpoint)
    if query_name:
        w = w.queryName(query_name)
    return _trigger(w, trigger, available_now).start()


def start_message_sink(
    msgs: DataFrame,
    path: str,
    checkpoint: str,
    writer: str,
    partitions: int = PARTITIONS,
    trigger: str | None = "3 seconds",
    available_now: bool = False,
) -> StreamingQuery:
    """K1 / K8 as a stream: each micro-batch's messages published in the log
    at ``path`` by one commit. ``writer`` names the query; a batch that is
    replayed is published once."""
    register_log(msgs.sparkSession)
    w = log_rows(msgs, partitions).writeStream.format(FORMAT).outputMode("append").option("checkpointLocation", checkpoint)
    w = w.option("path", path).option("writer", writer).option("partitions", partitions)
    return _trigger(w, trigger, available_now).start()


def start_storage(
    parsed: DataFrame,
    valid_path: str,
    error_path: str,
    checkpoint_root: str,
    partition_cols=PARTITION_COLUMNS,
    trigger: str | None = "10 seconds",
    available_now: bool = False,
) -> tuple[StreamingQuery, StreamingQuery]:
    """The valid and error stores as two independent queries."""
    valid, error = split_stream(parsed)
    root = checkpoint_root.rstrip("/")
    qv = start_parquet_sink(valid, valid_path, f"{root}/valid", partition_cols, trigger, available_now)
    qe = start_parquet_sink(error, error_path, f"{root}/error", partition_cols, trigger, available_now)
    return qv, qe
