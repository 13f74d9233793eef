"""Dimension joins and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def zone_role(zones: DataFrame, role: str, key: str) -> DataFrame:
    """The zone dimension renamed for one role (pickup / dropoff)."""
    return zones.select(
        F.col("LocationID").alias(key),
        F.col("Borough").alias(f"{role}_borough"),
        F.col("Zone").alias(f"{role}_zone"),
    )


def enrich_zones(
    df: DataFrame, zones: DataFrame, pickup_key: str = "PULocationID", dropoff_key: str = "DOLocationID"
) -> DataFrame:
    """J1 + J2: left joins of the zone dimension in its pickup and dropoff
    roles. Whether it is broadcast follows its size in bytes, from statistics
    or from the running query; ``USING`` joins put the keys first."""
    pu = zone_role(zones, "pickup", pickup_key)
    do = zone_role(zones, "dropoff", dropoff_key)
    return df.join(pu, on=pickup_key, how="left").join(do, on=dropoff_key, how="left")


def _anti(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key (null-safe) is not in ``other``. Both sides are
    aliased, so inputs that share lineage do not make the condition ambiguous."""
    a = df.alias("_l")
    b = other.select(*keys).alias("_r")
    cond = [F.col(f"_l.`{k}`").eqNullSafe(F.col(f"_r.`{k}`")) for k in keys]
    return a.join(b, cond, "left_anti").select(*[F.col(f"_l.`{c}`").alias(c) for c in df.columns])


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, plus all of ``new``.

    A shuffled (or, for a small ``new``, broadcast) anti-join on the key;
    re-applying the same ``new`` is idempotent."""
    return _anti(old, new, list(keys)).unionByName(new)


def rows_not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Set difference by key (null-safe)."""
    return _anti(df, other, list(keys))
