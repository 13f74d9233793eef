"""Validity rules, quarantine split, outlier bounds and calendar filters."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cabline.schema import (
    AMOUNT_MAX,
    DISTANCE_MAX_KM,
    LOCATION_MAX,
    LOCATION_MIN,
    SPEED_MAX_KPH,
    SPEED_MIN_KPH,
    VALID_FLAGS,
    VALID_PAYMENT_TYPES,
)


def trip_rules(
    pickup: str = "tpep_pickup_datetime",
    dropoff: str = "tpep_dropoff_datetime",
    location_range: tuple[int, int] = (LOCATION_MIN, LOCATION_MAX),
) -> dict[str, Column]:
    """the 12 named conjuncts of a valid trip. An amount beyond AMOUNT_MAX fails too."""
    lo, hi = location_range
    return {
        "pickup_present": F.col(pickup).isNotNull(),
        "dropoff_present": F.col(dropoff).isNotNull(),
        "dropoff_after_pickup": F.col(dropoff) > F.col(pickup),
        "passenger_count_present": F.col("passenger_count").isNotNull(),
        "ratecode_present": F.col("RatecodeID").isNotNull(),
        "distance_positive": F.col("trip_distance") > 0,
        "fare_not_negative": F.col("fare_amount").between(0, AMOUNT_MAX),
        "total_not_negative": F.col("total_amount").between(0, AMOUNT_MAX),
        "pickup_location_in_domain": F.col("PULocationID").between(lo, hi),
        "dropoff_location_in_domain": F.col("DOLocationID").between(lo, hi),
        "flag_known": F.col("store_and_fwd_flag").isin(*VALID_FLAGS),
        "payment_type_known": F.col("payment_type").isin(*VALID_PAYMENT_TYPES),
    }


def rule_expr(rules: dict[str, Column] | None = None) -> Column:
    return reduce(and_, (rules or trip_rules()).values())


def split_valid(
    df: DataFrame, rules: dict[str, Column] | None = None, null_policy: str = "quarantine"
) -> tuple[DataFrame, DataFrame]:
    """(valid, error).

    ``null_policy="quarantine"``: a rule that evaluates to null counts as a
    failure, so ``valid`` and ``error`` partition the input.
    ``null_policy="drop"``: plain ``~rule``, which loses rows whose rule is
    null (the upstream behaviour).
    """
    cond = rule_expr(rules)
    valid = df.filter(cond)
    if null_policy == "drop":
        error = df.filter(~cond)
    elif null_policy == "quarantine":
        error = df.filter(~F.coalesce(cond, F.lit(False)))
    else:
        raise ValueError(f"unknown null_policy {null_policy!r}")
    return valid, error


def failed_rules(rules: dict[str, Column] | None = None) -> Column:
    """Names of the failed (false or null) conjuncts, for dead-letter rows."""
    r = rules or trip_rules()
    return F.filter(
        F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in r.items()]),
        lambda x: x.isNotNull(),
    )


def within_bounds(df: DataFrame, speed="trip_speed_kph", distance="trip_distance_km") -> DataFrame:
    """5 < speed < 120 and distance <= 160 km; null speed drops."""
    return df.filter((F.col(speed) > SPEED_MIN_KPH) & (F.col(speed) < SPEED_MAX_KPH)).filter(
        F.col(distance) <= DISTANCE_MAX_KM
    )


def calendar_window(year: int, month: int, day: int | None = None, hour: int | None = None):
    """[start, end) of a month, day or hour, without a zone."""
    import datetime as dt

    if day is None:
        start = dt.datetime(year, month, 1)
        end = dt.datetime(year + (month == 12), month % 12 + 1, 1)
    elif hour is None:
        start = dt.datetime(year, month, day)
        end = start + dt.timedelta(days=1)
    else:
        start = dt.datetime(year, month, day, hour)
        end = start + dt.timedelta(hours=1)
    return start, end


def calendar_filter(
    df: DataFrame, ts: str, year: int, month: int, day: int | None = None, hour: int | None = None
) -> DataFrame:
    """a month (and optionally day, hour) as a range on the raw timestamp,
    so Parquet row-group statistics can skip data. The bounds are texts cast
    in the session's zone; the driver's own zone plays no part."""
    start, end = (F.lit(t.isoformat(sep=" ")).cast("timestamp") for t in calendar_window(year, month, day, hour))
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))
