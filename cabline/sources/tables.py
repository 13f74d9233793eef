"""Scans of stored aggregates and the model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def read_aggregate(spark: SparkSession, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A stored aggregate table, from Parquet or (with ``jdbc``: url,
    table, properties) from a database; filters applied later push down."""
    if jdbc:
        return spark.read.jdbc(url=jdbc["url"], table=jdbc["table"], properties=jdbc.get("properties", {}))
    return spark.read.parquet(path)


def load_model(path: str) -> PipelineModel:
    """S9 (call after the session exists)."""
    return PipelineModel.load(path)
