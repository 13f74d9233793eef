"""Aggregations: monthly and route analytics, hourly counts, live counts and
zone names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cabline.functions.measures import exact_sum, round_half_up
from cabline.functions.timeparts import hour_start
from cabline.schema import ROUTE_KEYS, TIME_KEYS


def monthly_analytics(processed: DataFrame) -> DataFrame:
    """A1: per (year, month). Partial aggregation runs before the shuffle,
    so only one row per month and task crosses the network."""
    return processed.groupBy(*TIME_KEYS).agg(
        F.count(F.lit(1)).alias("trip_count"),
        round_half_up(exact_sum("total_amount")).alias("total_revenue"),
        round_half_up(F.avg("trip_distance_km")).alias("avg_distance_km"),
        round_half_up(F.avg("trip_duration_minutes")).alias("avg_duration_minutes"),
        round_half_up(F.avg("trip_speed_kph")).alias("avg_speed_kph"),
    )


def route_analytics(processed: DataFrame) -> DataFrame:
    """A2: per (year, month, pickup_zone, dropoff_zone); zones by name."""
    return processed.groupBy(*ROUTE_KEYS).agg(
        F.count(F.lit(1)).alias("trip_count"),
        round_half_up(F.avg("trip_distance_km")).alias("avg_distance_km"),
        round_half_up(F.avg("trip_duration_minutes")).alias("avg_duration_minutes"),
        round_half_up(F.avg("fare_amount")).alias("avg_fare"),
        round_half_up(exact_sum("total_amount")).alias("total_revenue"),
    )


def hourly_counts(df: DataFrame, ts: str = "tpep_pickup_datetime") -> DataFrame:
    """A3: trips per clock hour."""
    return df.groupBy(hour_start(ts).alias("pickup_hour")).agg(F.count(F.lit(1)).alias("trip_count"))


def live_counts(df: DataFrame, dim: str) -> DataFrame:
    """Trips per dimension value (e.g. pickup borough or zone)."""
    return df.groupBy(dim).agg(F.count(F.lit(1)).alias("trip_count"))


def zone_names(zones: DataFrame) -> DataFrame:
    """U4: distinct zone names with their first (lowest) location id."""
    return zones.groupBy("Zone").agg(F.min("LocationID").alias("first_location_id"))
