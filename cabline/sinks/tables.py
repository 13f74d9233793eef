"""Repeatable batch writes (K5, K6, K7, K9).

Re-running a month must not duplicate rows (the upstream jobs append):
partitioned outputs use dynamic partition overwrite, so a run replaces
exactly the partitions it produces; keyed tables are merged by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.operators.joins import replace_by_key
from cabline.session import path_exists, remove_path, shuffles_removed


def _files_layout(df: DataFrame, partition_cols, files_per_partition: int | None) -> DataFrame:
    """Bound the number and size of files per output partition.

    Default: the ``rebalance`` hint on the partition columns. AQE then sizes
    the write tasks: small partition values are coalesced into one task and
    a hot value (say a third of all rows) is split over several, so neither
    tasks x values small files nor one huge task appear. With
    ``files_per_partition`` the rows are hash-distributed on the partition
    columns plus a deterministic salt (stable under task retry)."""
    cols = list(partition_cols)
    if not files_per_partition:
        return df.hint("rebalance", *cols)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_partition))
    return df.repartition(*[F.col(c) for c in cols], salt).sortWithinPartitions(*cols)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition_cols=("year", "month"),
    files_per_partition: int | None = None,
    max_records_per_file: int | None = None,
) -> None:
    """K5: Parquet partitioned by ``partition_cols``; only the partitions
    present in ``df`` are replaced (dynamic overwrite)."""
    w = _files_layout(df, partition_cols, files_per_partition).write.mode("overwrite")
    w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", max_records_per_file)
    w.parquet(path)


def write_table(
    df: DataFrame, path: str | None = None, mode: str = "overwrite", jdbc: dict | None = None
) -> None:
    """K6: whole-table write. With ``jdbc`` (url, table, properties) it goes
    to a database through ``DataFrameWriter.jdbc`` (needs the driver jar);
    otherwise to Parquet at ``path``."""
    if jdbc:
        props = {"batchsize": "50000", **jdbc.get("properties", {})}
        df.write.jdbc(url=jdbc["url"], table=jdbc["table"], mode=mode, properties=props)
    else:
        df.write.mode(mode).parquet(path)


def replace_partitions(
    new: DataFrame, path: str | None = None, partition_cols=("year", "month"), requested: dict | None = None, jdbc: dict | None = None
) -> None:
    """K7 for aggregates keyed by (year, month[, ...]): the month's rows are
    replaced as a whole by dynamic partition overwrite; re-runs are
    idempotent and no old data is read back. ``requested`` names the one
    partition that this run stands for: see ``write_month``. With ``jdbc``
    the rows are appended to a database table; the caller deletes the month
    first, in the database's own transaction."""
    if jdbc:
        write_table(new, mode="append", jdbc=jdbc)
    elif requested:
        write_month(new, path, requested)
    else:
        write_partitioned(new, path, partition_cols)


def write_month(df: DataFrame, path: str, partition: dict, **kw) -> None:
    """K5 for one partition, ``{"year": 2024, "month": 1}`` say: afterwards
    it holds exactly the rows of ``df``, none if there are none. Dynamic
    overwrite alone would leave the old rows of a re-run without result."""
    spark = df.sparkSession
    folder = "/".join([path.rstrip("/"), *[f"{k}={v}" for k, v in partition.items()]])
    if df.isEmpty():
        if path_exists(spark, folder):
            remove_path(spark, folder)
        return
    write_partitioned(df, path, tuple(partition), **kw)


def merge_by_key(spark: SparkSession, new: DataFrame, path: str, keys, out_path: str) -> DataFrame:
    """J5 + K7 for keyed tables that are not partitioned by their key: old
    rows whose key is in ``new`` are replaced. Written to ``out_path`` (a new
    version; a table is never overwritten while it is being read)."""
    if not path_exists(spark, path):  # first run; a table that can't be read fails below
        new.write.mode("overwrite").parquet(out_path)
        return spark.read.parquet(out_path)
    replace_by_key(spark.read.parquet(path), new, list(keys)).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def write_and_read(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a table at ``path``, for uses that scan it several times: packed,
    and without the shuffles behind it."""
    with shuffles_removed(df.sparkSession):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_model(model, path: str) -> None:
    """K9."""
    model.write().overwrite().save(path)
