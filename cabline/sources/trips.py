"""Trip file scans and the schema standardiser."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cabline.schema import SOURCE_RENAMES, TRIP_SCHEMA


def trip_file(root: str, taxi_type: str, year: int, month: int) -> str:
    return f"{root.rstrip('/')}/{taxi_type}_tripdata_{year:04d}-{month:02d}.parquet"


def read_trips(spark: SparkSession, root: str, taxi_type: str, year: int, month: int) -> DataFrame:
    """One monthly source file; a missing file fails (PATH_NOT_FOUND)."""
    return standardize(spark.read.parquet(trip_file(root, taxi_type, year, month)))


def standardize(
    df: DataFrame,
    schema: StructType = TRIP_SCHEMA,
    renames: dict | None = None,
    keep_extra: bool = False,
) -> DataFrame:
    """One projection to the standard schema.

    Known alternative spellings are renamed, absent columns become typed
    nulls and every column is ``try_cast`` to its standard type, so a bad
    value nulls its cell only."""
    renames = SOURCE_RENAMES if renames is None else renames
    present = {c: c for c in df.columns}
    for src, dst in renames.items():
        if src in present and dst not in present:
            present[dst] = src
    cols = []
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f"`{present[f.name]}`").try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    used = {present[f.name] for f in schema.fields if f.name in present}
    if keep_extra:
        cols += [F.col(f"`{c}`") for c in df.columns if c not in used and c not in schema.names]
    return df.select(*cols)


def read_valid(spark: SparkSession, root: str, year: int, month: int) -> DataFrame:
    """One month of stored valid trips. The root is read with a filter
    on the partition columns, so only that month's folders are listed."""
    return spark.read.parquet(root).filter((F.col("year") == year) & (F.col("month") == month))


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """The whole processed history (columns pruned by the consumer)."""
    return spark.read.parquet(root)
