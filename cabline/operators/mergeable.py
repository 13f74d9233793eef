"""Aggregates kept as mergeable states (A1, A2, K7).

An average can't be corrected, its sum and count can. Each load of trips
writes the states of its groups, partitioned by month and load; reading adds
the loads up. Late trips are a further load, so nothing older is read or
computed again; a load that runs again overwrites its own partitions; a
corrected month replaces all loads of the month. ``compact`` folds the loads
of a month into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.functions.measures import exact_sum, round_half_up
from cabline.schema import ROUTE_KEYS, TIME_KEYS
from cabline.session import child_names, remove_path, scratch_path
from cabline.sinks.tables import write_and_read, write_partitioned

#: Of each table: its keys, the summed column, and each average with its column.
MONTHLY = (tuple(TIME_KEYS), {"avg_distance_km": "trip_distance_km", "avg_duration_minutes": "trip_duration_minutes", "avg_speed_kph": "trip_speed_kph"})
ROUTES = (tuple(ROUTE_KEYS), {"avg_distance_km": "trip_distance_km", "avg_duration_minutes": "trip_duration_minutes", "avg_fare": "fare_amount"})
_LOADS = ("year", "month", "load")


def states(processed: DataFrame, table=MONTHLY) -> DataFrame:
    """One row per group: trips, revenue, and for each average the exact sum and the number of values."""
    keys, averages = table
    return processed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trip_count"), exact_sum("total_amount").alias("revenue"),
        *[f for out, c in averages.items() for f in (exact_sum(c).alias(f"{out}_sum"), F.count(c).alias(f"{out}_n"))],
    )


def merged(states_: DataFrame, table=MONTHLY) -> DataFrame:
    """States of the same group added up."""
    keys, _ = table
    values = [c for c in states_.columns if c not in (*keys, "load")]
    return states_.groupBy(*keys).agg(*[F.sum(c).cast(states_.schema[c].dataType).alias(c) for c in values])


def finished(states_: DataFrame, table=MONTHLY) -> DataFrame:
    """The columns of ``monthly_analytics`` or ``route_analytics`` from merged states."""
    keys, averages = table
    avg = [round_half_up(F.try_divide(F.col(f"{out}_sum").cast("double"), F.col(f"{out}_n"))).alias(out) for out in averages]
    return states_.select(*keys, "trip_count", round_half_up("revenue").alias("total_revenue"), *avg)


def write_load(processed: DataFrame, path: str, load: str, table=MONTHLY) -> None:
    """The states of one load of trips; running it again replaces the load's partitions."""
    write_partitioned(states(processed, table).withColumn("load", F.lit(load)), path, _LOADS)


def replace_month(processed: DataFrame, path: str, year: int, month: int, load: str, table=MONTHLY) -> None:
    """A corrected month: afterwards it holds the states of ``processed`` alone, none if there are no trips."""
    write_load(processed.where((F.col("year") == year) & (F.col("month") == month)), path, load, table)
    _drop_loads(processed.sparkSession, path, year, month, {load})


def _drop_loads(spark: SparkSession, path: str, year: int, month: int, kept: set[str]) -> None:
    folder = f"{path.rstrip('/')}/year={year}/month={month}"
    for name in child_names(spark, folder):
        if name.startswith("load=") and name[5:] not in kept:
            remove_path(spark, f"{folder}/{name}")


def read_states(spark: SparkSession, path: str, table=MONTHLY) -> DataFrame:
    """All loads added up; filters on year and month prune partitions."""
    return merged(spark.read.parquet(path), table)


def compact(spark: SparkSession, path: str, year: int, month: int, load: str, table=MONTHLY) -> None:
    """The loads of a month as one, named ``load``."""
    old = spark.read.parquet(path).where((F.col("year") == year) & (F.col("month") == month))
    one = write_and_read(merged(old, table), scratch_path(spark, "compact"))
    write_partitioned(one.withColumn("load", F.lit(load)), path, _LOADS)
    _drop_loads(spark, path, year, month, {load})
