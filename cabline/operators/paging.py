"""Pages at any offset by order statistics.

``page`` sends offset + limit rows to one task. Here the rows are written once
in order: range partitions, each row with its place in its partition, and a
small index with the rows before each partition. A page then opens only the
partitions that hold its rows, whatever the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cabline.operators.serving import _check_page

#: Bits of a row's place in its partition, as Spark numbers rows.
PLACE_BITS = 33


def write_page_index(df: DataFrame, order: list[Column | str], path: str, partitions: int | None = None) -> None:
    """``df`` ordered by ``order`` below ``path``. Rows that tie in ``order`` come in any order, but keep it."""
    parts = [partitions] if partitions else []
    ordered = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    part, place = F.shiftright("_id", PLACE_BITS).cast("int"), F.col("_id").bitwiseAND((1 << PLACE_BITS) - 1)
    rows = ordered.select(*df.columns, part.alias("_part"), place.alias("_place"))
    rows.write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows")
    # one row for each partition: the only thing that is summed in one task
    counts = df.sparkSession.read.schema("_part int").parquet(f"{path}/rows").groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy("_part"))
    counts.select("_part", (upto - F.col("n")).alias("first"), upto.alias("next")).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")
    df.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # for a table without rows


def page_total(spark: SparkSession, path: str) -> int:
    """A6 from the index."""
    return spark.read.parquet(f"{path}/index").agg(F.coalesce(F.max("next"), F.lit(0))).first()[0]


def page_at(spark: SparkSession, path: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """L1 + A6: the rows ``[offset, offset + limit)`` with ``total``, in
    order; no row past the end. To the driver come the index rows of the
    partitions that hold the page."""
    _check_page(offset, limit)
    total = page_total(spark, path)
    index = spark.read.parquet(f"{path}/index").where((F.col("first") < offset + limit) & (F.col("next") > offset))
    first = {r["_part"]: r["first"] for r in index.collect()}
    empty = spark.read.parquet(f"{path}/columns")
    if not first:
        return empty.withColumn("total", F.lit(total).cast("long"))
    columns = empty.columns
    rows = spark.read.parquet(f"{path}/rows").where(F.col("_part").isin(list(first)))
    before = F.coalesce(*[F.when(F.col("_part") == p, F.lit(n)) for p, n in first.items()])
    at = (before + F.col("_place")).alias("_at")
    rows = rows.select(*columns, at).where((F.col("_at") >= offset) & (F.col("_at") < offset + limit))
    return rows.orderBy("_at").select(*columns, F.lit(total).cast("long").alias("total"))
