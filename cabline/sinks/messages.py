"""Message sinks (K1, K8): keyed JSON messages to Kafka or to files.

Kafka needs the connector on the classpath; the file form writes the same
``key`` / ``value`` columns (JSON lines, or the bare value as text) so that
``streaming.ingest.StreamSource(format="text")`` can replay them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class MessageTarget:
    format: str = "kafka"  # "kafka", "json" or "text"
    topic: str | None = None
    bootstrap_servers: str | None = None
    path: str | None = None


def write_messages(msgs: DataFrame, target: MessageTarget, files: int | None = None, rows_per_file: int | None = None) -> None:
    """Batch write of ``(key, value[, topic])`` rows; ``files``: as many files instead of as the bytes need.
    ``rows_per_file``: the tasks that made the messages write them where they
    are, packed, each file of at most so many; a packed file is read by one task."""
    if target.format == "kafka":
        out = msgs.select("key", "value")
        w = out.write.format("kafka").option("kafka.bootstrap.servers", target.bootstrap_servers)
        if target.topic:
            w = w.option("topic", target.topic)
        w.save()
        return
    # files follow the bytes, not the keys: a hot key is split, few rows make few files
    options = {}
    if rows_per_file:
        out, options = msgs, {"maxRecordsPerFile": rows_per_file, "compression": "gzip"}
    else:
        out = msgs.repartition(files) if files else msgs.hint("rebalance")
    if target.format == "text":
        out.select("value").write.mode("overwrite").options(**options).text(target.path)
    elif target.format == "json":
        out.select("key", "value").write.mode("overwrite").options(**options).json(target.path)
    else:
        raise ValueError(f"unknown message format {target.format!r}")
