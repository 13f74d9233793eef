"""Route aggregates clustered by zone for zone requests.

The month-partitioned table makes a zone request open every file. Here each
route stands under both its zones in folders by a hash of the zone, so a
request opens the one folder that its zone falls into. Buckets are hashed, so
many zones make no many small folders; a bucket that a busy zone fills is split
into files by bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.schema import TOP_ROUTES_K
from cabline.sinks.tables import write_partitioned

BUCKETS = 64


def _bucket(zone, buckets: int) -> Column:
    return F.pmod(F.xxhash64(zone), F.lit(buckets)).cast("int")


def write_zone_store(routes: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Each route once under its pickup zone (role 0) and once under its dropoff zone (role 1); null zones under none."""
    role = F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(z).alias("zone")) for k, z in enumerate(("pickup_zone", "dropoff_zone"))]))
    under = routes.select("*", role.alias("_u")).select(*routes.columns, "_u.*").where(F.col("zone").isNotNull())
    under = under.withColumn("bucket", _bucket("zone", buckets))
    write_partitioned(under, path, ("bucket",))


def bucket_of(spark: SparkSession, zone: str, buckets: int = BUCKETS) -> int:
    return spark.range(1).select(_bucket(F.lit(zone), buckets)).first()[0]


def _of_zone(spark: SparkSession, path: str, zone: str, buckets: int) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.where((F.col("bucket") == bucket_of(spark, zone, buckets)) & (F.col("zone") == zone)).drop("bucket", "zone")


def zone_routes(spark: SparkSession, path: str, zone: str, buckets: int = BUCKETS) -> DataFrame:
    """As ``serving.routes_by_zone``: pickup matches (``match_order`` 0), then dropoff matches that are none (1)."""
    rows = _of_zone(spark, path, zone, buckets)
    once = (F.col("role") == 0) | ~F.coalesce(F.col("pickup_zone") == zone, F.lit(False))
    return rows.where(once).withColumnRenamed("role", "match_order").orderBy("match_order", "year", "month", "pickup_zone", "dropoff_zone")


def zone_top(spark: SparkSession, path: str, zone: str, year: int, month: int, direction: str, k: int = TOP_ROUTES_K, buckets: int = BUCKETS) -> DataFrame:
    """L3 + F6: as ``serving.top_routes``: the k busiest routes from (pickup) or to (dropoff) the zone in a month."""
    role, other = (0, "dropoff_zone") if direction == "pickup" else (1, "pickup_zone")
    rows = _of_zone(spark, path, zone, buckets).where((F.col("role") == role) & (F.col("year") == year) & (F.col("month") == month)).drop("role")
    return rows.orderBy(F.col("trip_count").desc(), F.col(other).asc_nulls_first()).limit(k)
