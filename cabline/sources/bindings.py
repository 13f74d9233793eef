"""Trip-shaped views over the star-schema test tables.

The test data holds no taxi trips. One trip is bound to every ``lineitem``
row through ``lineitem - orders - supplier - customer``; a few derived
columns are nulled or pushed out of domain on purpose, so every validity
rule and default is exercised. Zones are ``nation - region``.

Plan notes: ``lineitem`` and ``orders`` are both fact-sized, so that join
is a sort-merge join on the order key (hinted: orders is never broadcast,
its size grows with the data). Customer is joined to orders before that,
so lineitem is shuffled only once. Supplier and customer joins are left to
the optimizer (broadcast when their statistics are small, sort-merge
otherwise), so nothing is broadcast on faith.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.functions.timeparts import plus_seconds
from cabline.schema import TRIP_COLUMNS, TRIP_SCHEMA


_PLANS: dict = {}


def session_memo(spark: SparkSession, key: tuple, build):
    """Reuse a lazily built DataFrame plan for the life of a session (like a
    temp view): files are listed and plans analysed once, every action still
    reads and computes the data in full."""
    k = (spark.sparkContext.applicationId, id(spark)) + key
    if k not in _PLANS:
        _PLANS[k] = build()
    return _PLANS[k]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return session_memo(spark, ("table", path), lambda: spark.read.parquet(path))


def trips_from_tables(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame
) -> DataFrame:
    li = lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    )
    o = orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    s = supplier.select("s_suppkey", "s_nationkey")
    c = customer.select("c_custkey", "c_nationkey")
    # Customer attaches to orders first (orders is a quarter of lineitem),
    # so lineitem, the largest table, is shuffled once: by the order key for
    # the sort-merge join with (orders + customer). That side grows with the
    # data and is never broadcast.
    oc = o.join(c, o.o_custkey == c.c_custkey)
    j = li.join(oc.hint("merge"), li.l_orderkey == oc.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    pk, ln = F.col("l_partkey"), F.col("l_linenumber")
    f = F.col("l_extendedprice") / F.lit(1000)
    pickup = plus_seconds("o_orderdate", (pk * 37 + ln * 101) % 86400)
    dropoff = plus_seconds(pickup, (F.col("l_orderkey") * 13 + pk * 7) % 5400)
    cols = {
        "VendorID": (F.col("l_suppkey") % 2 + 1).cast("int"),
        "tpep_pickup_datetime": pickup,
        "tpep_dropoff_datetime": dropoff,
        "passenger_count": F.nullif(ln, F.lit(7)).cast("int"),
        "trip_distance": F.when(pk % 97 == 0, F.lit(None)).otherwise(F.col("l_quantity") / 2),
        "RatecodeID": F.nullif(ln.cast("double"), F.lit(6.0)),
        "store_and_fwd_flag": F.when(F.col("l_returnflag") == "A", F.lit(None))
        .when(F.col("l_returnflag") == "R", F.lit("Y"))
        .otherwise(F.lit("N")),
        "PULocationID": F.when(pk % 53 == 0, F.lit(0)).otherwise(F.col("s_nationkey") + 1).cast("int"),
        "DOLocationID": (F.col("c_nationkey") + 1).cast("int"),
        "payment_type": (pk % 8).cast("int"),
        "fare_amount": F.when(pk % 89 == 0, -f).otherwise(f),
        "extra": F.lit(0.5),
        "mta_tax": F.lit(0.5),
        "tip_amount": f * F.col("l_discount"),
        "tolls_amount": F.lit(0.0),
        "improvement_surcharge": F.lit(0.3),
        "total_amount": f * (F.lit(1) + F.col("l_tax")),
        "congestion_surcharge": F.nullif(F.col("l_discount"), F.lit(0.0)),
        "airport_fee": F.lit(None).cast("double"),
    }
    return j.select(*[cols[name].cast(TRIP_SCHEMA[name].dataType).alias(name) for name in TRIP_COLUMNS])


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_memo(spark, ("trips", sf_dir), lambda: trips_from_tables(
        table(spark, sf_dir, "lineitem"),
        table(spark, sf_dir, "orders"),
        table(spark, sf_dir, "supplier"),
        table(spark, sf_dir, "customer"),
    ))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zone dimension: ``LocationID = n_nationkey + 1``, Zone = nation name,
    Borough = region name."""
    def build():
        n = table(spark, sf_dir, "nation")
        r = table(spark, sf_dir, "region")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left").select(
            (F.col("n_nationkey") + 1).cast("int").alias("LocationID"),
            F.col("r_name").alias("Borough"),
            F.col("n_name").alias("Zone"),
            F.lit(None).cast("string").alias("service_zone"),
        )

    return session_memo(spark, ("zones", sf_dir), build)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event stream table; ``ts`` as a session-zone timestamp."""
    return session_memo(
        spark, ("events", sf_dir),
        lambda: table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")),
    )


# SQL twin of the bindings for the DuckDB oracle (tables are views there).
TRIPS_SQL = """
trips AS (
  SELECT
    CAST(l.l_suppkey % 2 + 1 AS INTEGER) AS VendorID,
    CAST(o.o_orderdate AS TIMESTAMP) + to_seconds((l.l_partkey * 37 + l.l_linenumber * 101) % 86400) AS tpep_pickup_datetime,
    CAST(o.o_orderdate AS TIMESTAMP) + to_seconds((l.l_partkey * 37 + l.l_linenumber * 101) % 86400)
      + to_seconds((l.l_orderkey * 13 + l.l_partkey * 7) % 5400) AS tpep_dropoff_datetime,
    CAST(nullif(l.l_linenumber, 7) AS INTEGER) AS passenger_count,
    CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE l.l_quantity / 2 END AS trip_distance,
    nullif(CAST(l.l_linenumber AS DOUBLE), 6.0) AS RatecodeID,
    CASE WHEN l.l_returnflag = 'A' THEN NULL WHEN l.l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS store_and_fwd_flag,
    CAST(CASE WHEN l.l_partkey % 53 = 0 THEN 0 ELSE s.s_nationkey + 1 END AS INTEGER) AS PULocationID,
    CAST(c.c_nationkey + 1 AS INTEGER) AS DOLocationID,
    CAST(l.l_partkey % 8 AS INTEGER) AS payment_type,
    CASE WHEN l.l_partkey % 89 = 0 THEN -(l.l_extendedprice / 1000) ELSE l.l_extendedprice / 1000 END AS fare_amount,
    0.5::DOUBLE AS extra,
    0.5::DOUBLE AS mta_tax,
    (l.l_extendedprice / 1000) * l.l_discount AS tip_amount,
    0.0::DOUBLE AS tolls_amount,
    0.3::DOUBLE AS improvement_surcharge,
    (l.l_extendedprice / 1000) * (1 + l.l_tax) AS total_amount,
    nullif(l.l_discount, 0.0) AS congestion_surcharge,
    CAST(NULL AS DOUBLE) AS airport_fee
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
)"""

ZONES_SQL = """
zones AS (
  SELECT CAST(n.n_nationkey + 1 AS INTEGER) AS LocationID, r.r_name AS Borough,
         n.n_name AS Zone, CAST(NULL AS VARCHAR) AS service_zone
  FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""
