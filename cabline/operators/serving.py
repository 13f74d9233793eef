"""Dashboard queries over the stored aggregates, as DataFrame functions.

Time finders (F6-F9, L2, L4), route finders (F6, F9, L3, W7, U1-U3, W6,
F11, L6), zone names (U4), paging (L1, A6) and chart labels (P18-P20).
Parameters are plain Python values; plans stay lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabline.functions.measures import round_half_up
from cabline.functions.timeparts import iso_text, month_label_from_parts, month_picker
from cabline.operators.analytics import zone_names
from cabline.schema import PAGE_LIMIT_MAX, PAGE_LIMIT_MIN, POPULAR_ROUTES_SHOWN, TOP_ROUTES_K


# ---- time analytics ----------------------------------------------------------


def time_analytics(df: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    """equality on (year, month) when both are given, otherwise all
    rows ordered by year, month descending (L2)."""
    if year is not None and month is not None:
        return df.filter((F.col("year") == year) & (F.col("month") == month))
    return df.orderBy(F.col("year").desc(), F.col("month").desc())


def year_range(df: DataFrame, start_year: int, end_year: int) -> DataFrame:
    """inclusive year range."""
    return df.filter(F.col("year").between(start_year, end_year))


def time_range(df: DataFrame, start_year: int, start_month: int, end_year: int, end_month: int) -> DataFrame:
    """F8 + L4: inclusive (year, month) range, ascending.

    A range on ``year * 12 + month``, with the years as well, so stored
    partitions are pruned. An inverted range (start after end) is empty."""
    ym = F.col("year") * 12 + F.col("month")
    lo, hi = start_year * 12 + start_month, end_year * 12 + end_month
    return df.filter(F.col("year").between(start_year, end_year) & ym.between(lo, hi)).orderBy("year", "month")


# ---- route analytics -----------------------------------------------------------


def route_analytics_query(
    df: DataFrame, year: int | None = None, month: int | None = None, zone: str | None = None
) -> DataFrame:
    """F9 for routes: year+month wins (zone ignored), else zone (U1), else all."""
    if year is not None and month is not None:
        return df.filter((F.col("year") == year) & (F.col("month") == month))
    if zone is not None:
        return routes_by_zone(df, zone)
    return df


def routes_by_zone(df: DataFrame, zone: str) -> DataFrame:
    """Routes touching a zone, each row once; pickup matches first
    (``match_order`` 0), then dropoff-only matches (1), in that order."""
    pu, do = F.col("pickup_zone") == zone, F.col("dropoff_zone") == zone
    out = df.filter(pu | do).withColumn("match_order", F.when(pu, 0).otherwise(1))
    return out.orderBy("match_order", "year", "month", "pickup_zone", "dropoff_zone")


def dropoff_only(df: DataFrame, zone: str) -> DataFrame:
    """Dropoff matches that are not also pickup matches. Same rows as an
    anti-join on the 4-part key, written as one filter (no shuffle)."""
    return df.filter((F.col("dropoff_zone") == zone) & ~F.coalesce(F.col("pickup_zone") == zone, F.lit(False)))


def _other(direction: str) -> str:
    return "dropoff_zone" if direction == "pickup" else "pickup_zone"


def top_routes(df: DataFrame, year: int, month: int, zone: str, direction: str, k: int = TOP_ROUTES_K) -> DataFrame:
    """L3: the k busiest routes from (pickup) or to (dropoff) one zone in a
    month. Ties broken by the other zone's name. ``TakeOrderedAndProject``:
    each task keeps k rows, no full sort."""
    key = f"{direction}_zone"
    return (
        df.filter((F.col("year") == year) & (F.col("month") == month) & (F.col(key) == zone))
        .orderBy(F.col("trip_count").desc(), F.col(_other(direction)).asc_nulls_first())
        .limit(k)
    )


def top_routes_by_zone(df: DataFrame, year: int, month: int, zone: str, k: int = TOP_ROUTES_K) -> DataFrame:
    """Both lists in one frame, tagged by ``direction`` with ``rank``."""
    parts = []
    for direction in ("pickup", "dropoff"):
        t = top_routes(df, year, month, zone, direction, k)
        w = Window.partitionBy(F.col(f"{direction}_zone")).orderBy(
            F.col("trip_count").desc(), F.col(_other(direction)).asc_nulls_first()
        )
        parts.append(t.withColumn("direction", F.lit(direction + "s")).withColumn("rank", F.row_number().over(w)))
    return parts[0].unionByName(parts[1])


def top_routes_all(df: DataFrame, k: int = TOP_ROUTES_K) -> DataFrame:
    """W7 + U3 for every (year, month, zone) at once: each route stands under
    both its zones, and one window takes the top k of each (month, direction,
    zone): one pass, one shuffle, no global sort."""
    under = F.explode(F.array(*[
        F.struct(F.lit(f"{d}s").alias("direction"), F.col(f"{d}_zone").alias("zone"), F.col(_other(d)).alias("other"))
        for d in ("pickup", "dropoff")
    ]))
    x = df.select("*", under.alias("_u")).select(*df.columns, "_u.*").filter(F.col("zone").isNotNull())
    w = Window.partitionBy("year", "month", "direction", "zone").orderBy(
        F.col("trip_count").desc(), F.col("other").asc_nulls_first()
    )
    x = x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return x.select(*df.columns, "rank", "direction", "zone")


def popular_routes(df: DataFrame, year: int, month: int, zone: str, k: int = TOP_ROUTES_K,
                   shown: int = POPULAR_ROUTES_SHOWN) -> DataFrame:
    """Pickups then dropoffs (W6 first occurrence per route), without the
    zone's self-loop (F11), first ``shown`` (L6). Works on at most 2k rows."""
    t = top_routes_by_zone(df, year, month, zone, k)
    t = t.withColumn("position", F.when(F.col("direction") == "pickups", 0).otherwise(k) + F.col("rank") - 1)
    t = t.filter(~((F.col("pickup_zone") == zone) & (F.col("dropoff_zone") == zone)))
    first = Window.partitionBy("pickup_zone", "dropoff_zone").orderBy("position")
    t = t.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") == 1).drop("_n")
    return t.orderBy("position").limit(shown)


# ---- zone names -------------------------------------------------------------------


def zone_name_list(zones: DataFrame) -> DataFrame:
    """U4: each distinct zone name once, in first-id order."""
    return zone_names(zones).orderBy("first_location_id")


# ---- paging --------------------------------------------------------------------------


def page(df: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 100) -> DataFrame:
    """L1 + A6: one page ``[offset, offset + limit)`` of the ordered rows, with
    the filtered ``total`` attached as a scalar subquery (a global count with
    partial aggregation, not a single-partition window)."""
    _check_page(offset, limit)
    total = df.select(F.count(F.lit(1))).scalar()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def _check_page(offset: int, limit: int) -> None:
    if offset < 0:
        raise ValueError("offset must be >= 0")
    if not PAGE_LIMIT_MIN <= limit <= PAGE_LIMIT_MAX:
        raise ValueError(f"limit must be in [{PAGE_LIMIT_MIN}, {PAGE_LIMIT_MAX}]")


def page_envelope(df: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """The one row that goes with a page: ``status`` (``done`` past the end,
    else ``ok``), ``total``, ``offset`` and ``limit``, also for an empty page."""
    _check_page(offset, limit)
    status = F.when(F.lit(offset) >= F.col("total"), F.lit("done")).otherwise(F.lit("ok"))
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        status.alias("status"), "total", F.lit(offset).cast("long").alias("offset"), F.lit(limit).cast("long").alias("limit")
    )


def page_after(df: DataFrame, order: list[str], last: dict | None, limit: int = 100) -> DataFrame:
    """The page after the row ``last`` (its values of ``order``, nulls
    first; None: the first page). Unlike an offset, the rows before it are
    filtered out at the scan and never sent to one task."""
    _check_page(0, limit)
    if last is not None:
        after = F.lit(False)
        for c in reversed(order):
            col, value = F.col(c), F.lit(last[c]).cast(df.schema[c].dataType)
            greater = col.isNotNull() if last[c] is None else col > value
            after = F.coalesce(greater, F.lit(False)) | (col.eqNullSafe(value) & after)
        first = order[0]
        if last[first] is not None:  # what a scan can use
            df = df.filter(F.col(first) >= F.lit(last[first]).cast(df.schema[first].dataType))
        df = df.filter(after)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(limit)


def format_timestamps(df: DataFrame) -> DataFrame:
    """Every timestamp column as ISO text to the second."""
    ts = [f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "timestamp_ntz")]
    return df.withColumns({c: iso_text(c) for c in ts}) if ts else df


# ---- chart labels -------------------------------------------------------------------


def chart_labels(monthly: DataFrame) -> DataFrame:
    """Month label, revenue scaled by 1/10 to one place, count as
    text, and the ``yyyy-MM`` picker text parsed back to integers."""
    picker = F.format_string("%d-%02d", F.col("year"), F.col("month"))
    parsed = month_picker(picker)
    return monthly.select(
        "year",
        "month",
        month_label_from_parts("year", "month").alias("month_year"),
        round_half_up(F.col("total_revenue") / 10, 1).alias("revenue_scaled"),
        F.col("trip_count").cast("string").alias("trip_count_text"),
        parsed["year"].alias("picked_year"),
        parsed["month"].alias("picked_month"),
    )
