"""One stream, read once, into both stores and the live state.

Three queries over one source read and parse it three times. Here a
micro-batch is written once, each row into the store that its validity names;
the live sink then reads the batch's valid part back, only the columns it
needs. A batch counts once its commit file stands, which is written last: a
batch that was cut off anywhere is written again over its own folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.operators.rules import rule_expr
from cabline.session import child_names, path_exists


class FanOut:
    """``foreachBatch`` handler for parsed messages. ``live``: a handler of valid trips, idempotent on batch_id."""

    def __init__(self, path: str, live=None, partition_cols: tuple[str, ...] = ("year", "month")):
        self.path, self.live, self.partition_cols = path.rstrip("/"), live, partition_cols

    def __call__(self, batch_df: DataFrame, batch_id: int) -> None:
        spark, name = batch_df.sparkSession, f"batch_id={int(batch_id)}"
        if path_exists(spark, f"{self.path}/commits/{name}/_SUCCESS"):
            return
        store = F.when(F.coalesce(rule_expr(), F.lit(False)), F.lit("valid")).otherwise(F.lit("error"))
        rows = f"{self.path}/rows/{name}"
        tagged = batch_df.withColumn("store", store)
        if "_raw" in tagged.columns:  # a dead letter's text; of a valid message nobody reads it
            tagged = tagged.withColumn("_raw", F.when(F.col("store") == "error", F.col("_raw")))
        tagged = tagged.hint("rebalance", "store", *self.partition_cols)
        # the whole folder of the batch is replaced, also partitions that a first try wrote and this one doesn't
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("store", *self.partition_cols).parquet(rows)
        if self.live is not None:
            valid = spark.read.schema(tagged.schema).parquet(rows).where("store = 'valid'").drop("store", "_raw")
            self.live(valid, int(batch_id))
        spark.range(1).select(F.lit(int(batch_id)).alias("id")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{name}")


def committed(spark: SparkSession, path: str) -> list[int]:
    """The batches whose commit file stands."""
    root = f"{path.rstrip('/')}/commits"
    return sorted(int(n.split("=")[1]) for n in child_names(spark, root) if n.startswith("batch_id=") and path_exists(spark, f"{root}/{n}/_SUCCESS"))


def read_store(spark: SparkSession, path: str, store: str) -> DataFrame:
    """The rows of one store (``valid`` or ``error``) of all committed batches."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path.rstrip('/')}/rows")
    rows = rows.where((F.col("store") == store) & F.col("batch_id").isin(committed(spark, path)))
    return rows.drop("store", "batch_id", *(["_raw"] if store == "valid" else []))
