"""Zone dimension scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cabline.schema import ZONE_SCHEMA


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, typed at the scan (``LocationID INT``), so the
    join key never compares an int with a string."""
    return spark.read.schema(ZONE_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(path)


def write_zones_csv(zones: DataFrame, path: str) -> None:
    zones.hint("rebalance").write.mode("overwrite").option("header", True).csv(path)
