"""Named queries over the test tables and their DuckDB SQL twins.

Every query reads the whole tables (through the trip / zone bindings) so
its work grows with the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.plans import batch, ingest
from cabline.plans import oracle_sql as O
from cabline.sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---- shared building blocks -------------------------------------------------


def valid_and_error(spark: SparkSession, sf: str, null_policy: str = "quarantine"):
    return B.session_memo(
        spark, ("split", sf, null_policy), lambda: ingest.split(B.trips(spark, sf), null_policy=null_policy)
    )


def processed(spark: SparkSession, sf: str) -> DataFrame:
    def build():
        valid, _ = valid_and_error(spark, sf)
        return batch.process(valid, B.zones(spark, sf))

    return B.session_memo(spark, ("processed", sf), build)


# ---- ingest split (F1, F2, P1, P2) -----------------------------------------


@register("valid_trips", O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE {O.RULE}"))
def q_valid_trips(spark, sf):
    return valid_and_error(spark, sf)[0]


@register(
    "quarantine_trips",
    O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE NOT coalesce({O.RULE}, false)"),
)
def q_quarantine_trips(spark, sf):
    return valid_and_error(spark, sf)[1]


@register("quarantine_compat", O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE NOT {O.RULE}"))
def q_quarantine_compat(spark, sf):
    return valid_and_error(spark, sf, null_policy="drop")[1]


# ---- batch processing (J1, J2, P3-P8, F3, A1, A2) ---------------------------


@register("enriched_trips", O.with_ctes(*O.PROCESSED, body="SELECT * FROM processed"))
def q_enriched_trips(spark, sf):
    return processed(spark, sf)


@register("monthly_analytics", O.with_ctes(*O.PROCESSED, O.MONTHLY_SQL, body="SELECT * FROM monthly"))
def q_monthly_analytics(spark, sf):
    return batch.monthly_analytics(processed(spark, sf))


@register("route_analytics", O.with_ctes(*O.PROCESSED, O.ROUTES_SQL, body="SELECT * FROM routes"))
def q_route_analytics(spark, sf):
    return batch.route_analytics(processed(spark, sf))


# ---- serving over the stored aggregates (F6-F9, L1-L6, U1-U4, W6, W7) ------

from cabline.operators import serving as S  # noqa: E402
from cabline.schema import TRIP_COLUMNS, TRIP_SCHEMA  # noqa: E402
from cabline.session import child_names, folder_bytes, remove_path, scratch_path, shared_dir  # noqa: E402
from cabline.sinks import tables as K  # noqa: E402
from cabline.sources import tables as ST  # noqa: E402

# Fixed request parameters of the serving queries (a month and a zone that
# exist at every scale factor).
YEAR, MONTH, ZONE = 1996, 3, "NATION_7"
RANGE = (1995, 6, 1997, 3)


def _stored(spark, sf, name: str, build) -> DataFrame:
    """An aggregate table, written once per session and scale factor by the
    batch job's sink (K7) below the shared folder, and scanned by every
    request (S8): filters on year and month prune its partitions."""
    def write():
        path = scratch_path(spark, name)
        K.replace_partitions(build(processed(spark, sf)), path)
        return path

    path = B.session_memo(spark, ("stored", name, sf), write)
    return ST.read_aggregate(spark, path)


def stored_monthly(spark, sf):
    return _stored(spark, sf, "analyze_by_time", batch.monthly_analytics)


def stored_routes(spark, sf):
    return _stored(spark, sf, "analyze_by_routes", batch.route_analytics)


_M = O.PROCESSED + (O.MONTHLY_SQL,)
_R = O.PROCESSED + (O.ROUTES_SQL,)


@register("time_by_month", O.with_ctes(*_M, body=f"SELECT * FROM monthly WHERE year = {YEAR} AND month = {MONTH}"))
def q_time_by_month(spark, sf):
    return S.time_analytics(stored_monthly(spark, sf), YEAR, MONTH)


@register("time_all_desc", O.with_ctes(*_M, body="SELECT * FROM monthly ORDER BY year DESC, month DESC"))
def q_time_all_desc(spark, sf):
    return S.time_analytics(stored_monthly(spark, sf))


@register(
    "time_range",
    O.with_ctes(
        *_M,
        body=f"SELECT * FROM monthly WHERE year * 12 + month BETWEEN {RANGE[0] * 12 + RANGE[1]}"
        f" AND {RANGE[2] * 12 + RANGE[3]} ORDER BY year, month",
    ),
)
def q_time_range(spark, sf):
    return S.time_range(stored_monthly(spark, sf), *RANGE)


@register("time_year_range", O.with_ctes(*_M, body="SELECT * FROM monthly WHERE year BETWEEN 1996 AND 1997"))
def q_time_year_range(spark, sf):
    return S.year_range(stored_monthly(spark, sf), 1996, 1997)


@register("routes_by_month", O.with_ctes(*_R, body=f"SELECT * FROM routes WHERE year = {YEAR} AND month = {MONTH}"))
def q_routes_by_month(spark, sf):
    return S.route_analytics_query(stored_routes(spark, sf), YEAR, MONTH, ZONE)


@register(
    "top_pickups",
    O.with_ctes(
        *_R,
        body=f"SELECT * FROM routes WHERE year = {YEAR} AND month = {MONTH} AND pickup_zone = '{ZONE}'"
        " ORDER BY trip_count DESC, dropoff_zone ASC NULLS FIRST LIMIT 5",
    ),
)
def q_top_pickups(spark, sf):
    return S.top_routes(stored_routes(spark, sf), YEAR, MONTH, ZONE, "pickup")


@register(
    "top_dropoffs",
    O.with_ctes(
        *_R,
        body=f"SELECT * FROM routes WHERE year = {YEAR} AND month = {MONTH} AND dropoff_zone = '{ZONE}'"
        " ORDER BY trip_count DESC, pickup_zone ASC NULLS FIRST LIMIT 5",
    ),
)
def q_top_dropoffs(spark, sf):
    return S.top_routes(stored_routes(spark, sf), YEAR, MONTH, ZONE, "dropoff")


@register(
    "top_routes_zone",
    O.with_ctes(
        *_R,
        body=f"{O.top_sql('pickup', YEAR, MONTH, ZONE)} UNION ALL {O.top_sql('dropoff', YEAR, MONTH, ZONE)}",
    ),
)
def q_top_routes_zone(spark, sf):
    return S.top_routes_by_zone(stored_routes(spark, sf), YEAR, MONTH, ZONE)


@register("top_routes_all", O.with_ctes(*_R, body=f"{O.top_all_sql('pickup')} UNION ALL {O.top_all_sql('dropoff')}"))
def q_top_routes_all(spark, sf):
    return S.top_routes_all(stored_routes(spark, sf))


@register(
    "routes_by_zone",
    O.with_ctes(
        *_R,
        body=f"SELECT *, CASE WHEN pickup_zone = '{ZONE}' THEN 0 ELSE 1 END AS match_order FROM routes"
        f" WHERE pickup_zone = '{ZONE}' OR dropoff_zone = '{ZONE}'",
    ),
)
def q_routes_by_zone(spark, sf):
    return S.route_analytics_query(stored_routes(spark, sf), zone=ZONE)


@register(
    "dropoff_only_routes",
    O.with_ctes(
        *_R,
        body=f"SELECT d.* FROM routes d WHERE d.dropoff_zone = '{ZONE}' AND NOT EXISTS ("
        f"SELECT 1 FROM routes p WHERE p.pickup_zone = '{ZONE}' AND p.year = d.year AND p.month = d.month"
        " AND p.pickup_zone = d.pickup_zone AND p.dropoff_zone = d.dropoff_zone)",
    ),
)
def q_dropoff_only_routes(spark, sf):
    return S.dropoff_only(stored_routes(spark, sf), ZONE)


@register(
    "popular_routes",
    O.with_ctes(
        *_R,
        f"""u AS (
  SELECT *, CAST(CASE WHEN direction = 'pickups' THEN 0 ELSE 5 END + rank - 1 AS INTEGER) AS position
  FROM ({O.top_sql('pickup', YEAR, MONTH, ZONE)} UNION ALL {O.top_sql('dropoff', YEAR, MONTH, ZONE)})
)""",
        f"""f AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY pickup_zone, dropoff_zone ORDER BY position) AS rn
    FROM u WHERE NOT (pickup_zone = '{ZONE}' AND dropoff_zone = '{ZONE}')) WHERE rn = 1
)""",
        body="SELECT * FROM f ORDER BY position LIMIT 10",
    ),
)
def q_popular_routes(spark, sf):
    return S.popular_routes(stored_routes(spark, sf), YEAR, MONTH, ZONE)


@register(
    "zone_names",
    O.with_ctes(O.ZONES_SQL, body="SELECT Zone, min(LocationID) AS first_location_id FROM zones GROUP BY Zone"),
)
def q_zone_names(spark, sf):
    return S.zone_name_list(B.zones(spark, sf))


_PAGE_OFFSET, _PAGE_LIMIT = 100, 50
_TS_COLS = ("tpep_pickup_datetime", "tpep_dropoff_datetime")


def _page_select() -> str:
    return ", ".join(
        f"strftime({c}, '%Y-%m-%dT%H:%M:%S') AS {c}" if c in _TS_COLS else c for c in TRIP_COLUMNS
    )


@register(
    "trip_page",
    O.with_ctes(
        O.TRIPS_SQL,
        f"f AS (SELECT * FROM trips WHERE tpep_pickup_datetime >= TIMESTAMP '{YEAR}-{MONTH:02d}-01'"
        f" AND tpep_pickup_datetime < TIMESTAMP '{YEAR}-{MONTH + 1:02d}-01')",
        body=f"SELECT {_page_select()}, (SELECT count(*) FROM f) AS total FROM f ORDER BY "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in ("tpep_pickup_datetime",) + tuple(c for c in TRIP_COLUMNS if c != "tpep_pickup_datetime"))
        + f" LIMIT {_PAGE_LIMIT} OFFSET {_PAGE_OFFSET}",
    ),
)
def q_trip_page(spark, sf):
    from cabline.functions.cleaning import null_non_finite
    from cabline.operators.rules import calendar_filter

    df = calendar_filter(B.trips(spark, sf), "tpep_pickup_datetime", YEAR, MONTH)
    return S.format_timestamps(null_non_finite(S.page(df, _ORDER_COLS, _PAGE_OFFSET, _PAGE_LIMIT)))


_ORDER_COLS = ["tpep_pickup_datetime"] + [c for c in TRIP_COLUMNS if c != "tpep_pickup_datetime"]


@register(
    "trip_page_done",
    O.with_ctes(
        O.TRIPS_SQL,
        f"f AS (SELECT * FROM trips WHERE tpep_pickup_datetime >= TIMESTAMP '{YEAR}-{MONTH:02d}-01'"
        f" AND tpep_pickup_datetime < TIMESTAMP '{YEAR}-{MONTH + 1:02d}-01')",
        body="SELECT 'done' AS status, count(*) AS total, CAST(1000000000 AS BIGINT) AS \"offset\","
        f" CAST({_PAGE_LIMIT} AS BIGINT) AS \"limit\" FROM f",
    ),
)
def q_trip_page_done(spark, sf):
    """The envelope past the last page: status and total, though no row is left."""
    from cabline.operators.rules import calendar_filter

    return S.page_envelope(calendar_filter(B.trips(spark, sf), "tpep_pickup_datetime", YEAR, MONTH), 1_000_000_000, _PAGE_LIMIT)


@register(
    "large_revenue_labels",
    O.with_ctes(
        *O.PROCESSED,
        "big AS (SELECT year, month, " + O.r2("sum(CAST(total_amount * 1e8 AS DECIMAL(28,8)))")
        + " AS total_revenue, count(*) AS trip_count FROM processed GROUP BY year, month)",
        body="SELECT year, month, total_revenue, " + O.r1("total_revenue / 10") + " AS revenue_scaled FROM big",
    ),
)
def q_large_revenue_labels(spark, sf):
    """Labels of months whose revenue is far beyond 1e11."""
    p = processed(spark, sf).withColumn("total_amount", F.col("total_amount") * F.lit(1e8))
    m = batch.monthly_analytics(p)
    return S.chart_labels(m).join(m.select("year", "month", "total_revenue"), ["year", "month"]).select(
        "year", "month", "total_revenue", "revenue_scaled"
    )


@register(
    "chart_labels",
    O.with_ctes(
        *_M,
        body="SELECT year, month, printf('%02d/%d', month, year) AS month_year, "
        + O.r1("total_revenue / 10")
        + " AS revenue_scaled, CAST(trip_count AS VARCHAR) AS trip_count_text,"
        " CAST(split_part(printf('%d-%02d', year, month), '-', 1) AS INTEGER) AS picked_year,"
        " CAST(split_part(printf('%d-%02d', year, month), '-', 2) AS INTEGER) AS picked_month FROM monthly",
    ),
)
def q_chart_labels(spark, sf):
    return S.chart_labels(stored_monthly(spark, sf))


# ---- per-row projections (S2, P1-P4, P8-P10, P14-P16) ---------------------

from cabline.functions import timeparts as TP  # noqa: E402
from cabline.functions.cleaning import fill_defaults, null_non_finite, payment_type_name  # noqa: E402
from cabline.operators import forecast as FC  # noqa: E402
from cabline.operators import replay as RP  # noqa: E402
from cabline.sources.trips import standardize  # noqa: E402

_TRIP_SELECT = ", ".join(TRIP_COLUMNS)


@register(
    "standardize_trips",
    O.with_ctes(
        O.TRIPS_SQL,
        body="SELECT * REPLACE (CAST(NULL AS DOUBLE) AS congestion_surcharge) FROM trips",
    ),
)
def q_standardize_trips(spark, sf):
    """A loosely typed source (all text, ``Airport_fee`` spelling, one column
    absent) brought back to the standard schema."""
    t = B.trips(spark, sf).withColumnRenamed("airport_fee", "Airport_fee").drop("congestion_surcharge")
    loose = t.select(*[F.col(c).cast("string").alias(c) for c in t.columns])
    return null_non_finite(standardize(loose))


@register(
    "calendar_parts",
    O.with_ctes(
        O.TRIPS_SQL,
        body="""SELECT tpep_pickup_datetime,
  CAST(year(tpep_pickup_datetime) AS INTEGER) AS year, CAST(month(tpep_pickup_datetime) AS INTEGER) AS month,
  CAST(day(tpep_pickup_datetime) AS INTEGER) AS day, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hour,
  printf('%02d:00', hour(tpep_pickup_datetime)) AS hour_label,
  strftime(tpep_pickup_datetime, '%A') AS weekday_name,
  strftime(tpep_pickup_datetime, '%m/%Y') AS month_label,
  date_trunc('hour', tpep_pickup_datetime) AS pickup_hour,
  CAST(dayofweek(tpep_pickup_datetime) + 1 AS INTEGER) AS day_of_week,
  CAST(dayofweek(tpep_pickup_datetime) IN (0, 6) AS INTEGER) AS is_weekend,
  strftime(tpep_pickup_datetime, '%Y-%m-%dT%H:%M:%S') AS iso_time,
  strftime(tpep_pickup_datetime, '%Y-%m-%d %H:%M:%S') AS message_time,
  strftime(tpep_pickup_datetime + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS predicted_time
FROM trips""",
    ),
)
def q_calendar_parts(spark, sf):
    t = TP.with_calendar(B.trips(spark, sf).select("tpep_pickup_datetime"))
    ts = "tpep_pickup_datetime"
    feats = TP.time_features(ts)
    return t.select(
        ts, "year", "month", "day", "hour",
        TP.hour_label("hour").alias("hour_label"),
        TP.weekday_name(ts).alias("weekday_name"),
        TP.month_label(ts).alias("month_label"),
        TP.hour_start(ts).alias("pickup_hour"),
        feats["day_of_week"].alias("day_of_week"),
        feats["is_weekend"].alias("is_weekend"),
        TP.iso_text(ts).alias("iso_time"),
        TP.message_time(ts).alias("message_time"),
        TP.message_time(TP.plus_hours(ts, 1)).alias("predicted_time"),
    )


@register("fill_defaults", O.with_ctes(O.TRIPS_SQL, O.FILLED_SQL, body="SELECT * FROM filled"))
def q_fill_defaults(spark, sf):
    return fill_defaults(B.trips(spark, sf))


@register(
    "payment_names",
    O.with_ctes(
        O.TRIPS_SQL,
        body=f"SELECT payment_type, {O.PAYMENT_CASE} AS payment_type_name, count(*) AS trip_count"
        " FROM trips GROUP BY 1, 2",
    ),
)
def q_payment_names(spark, sf):
    t = B.trips(spark, sf)
    return t.groupBy("payment_type", payment_type_name("payment_type").alias("payment_type_name")).agg(
        F.count(F.lit(1)).alias("trip_count")
    )


# ---- hourly series and label (A3, P9, P10, W1, F5) -----------------------------


@register("hourly_counts", O.with_ctes(*O.PROCESSED, O.HOURLY_SQL, body="SELECT * FROM hourly"))
def q_hourly_counts(spark, sf):
    return FC.hourly_series(processed(spark, sf))


@register(
    "next_hour_label",
    O.with_ctes(
        *O.PROCESSED,
        O.HOURLY_SQL,
        body="SELECT * FROM (SELECT *, lead(trip_count) OVER (ORDER BY pickup_hour) AS future_trip_count"
        " FROM hourly) WHERE future_trip_count IS NOT NULL",
    ),
)
def q_next_hour_label(spark, sf):
    return FC.add_label(FC.hourly_series(processed(spark, sf)), gap="skip")


@register(
    "next_hour_label_grid",
    O.with_ctes(
        *O.PROCESSED,
        O.HOURLY_SQL,
        body="SELECT h.*, n.trip_count AS future_trip_count FROM hourly h"
        " JOIN hourly n ON n.pickup_hour = h.pickup_hour + INTERVAL 1 HOUR",
    ),
)
def q_next_hour_label_grid(spark, sf):
    return FC.add_label(FC.hourly_series(processed(spark, sf)), gap="grid")


# ---- messages and replay (K1, S4, W2, W3) -----------------------------------------


@register(
    "keyed_messages",
    O.with_ctes(
        O.TRIPS_SQL,
        body="SELECT coalesce(CAST(PULocationID AS VARCHAR), 'default') AS key,"
        " 'yellow_trip_data' AS topic, * FROM trips",
    ),
)
def q_keyed_messages(spark, sf):
    return _decode_keeping(RP.to_messages(B.trips(spark, sf), taxi_type="yellow"))


def _decode_keeping(msgs):
    parsed = F.from_json(F.col("value"), RP.TRIP_SCHEMA, {"timestampFormat": RP.ISO_SECONDS_PATTERN})
    return msgs.select("key", "topic", parsed.alias("_d")).select("key", "topic", "_d.*")


@register(
    "decode_messages",
    O.with_ctes(
        O.TRIPS_SQL.replace("trips AS (", "whole AS ("),
        "trips AS (SELECT * REPLACE (CASE WHEN VendorID = 1 THEN tpep_pickup_datetime + INTERVAL 500 MILLISECOND"
        " ELSE tpep_pickup_datetime END AS tpep_pickup_datetime) FROM whole)",
        O.PREPARED_SQL,
        body="SELECT * FROM prepared",
    ),
)
def q_decode_messages(spark, sf):
    """Messages as other producers write them too: pickup times with a
    fraction (vendor 1), dropoff times with a blank instead of the T."""
    msgs = RP.to_messages(B.trips(spark, sf))
    pickup = F.regexp_replace("value", r'("VendorID":1,"tpep_pickup_datetime":"[^"]{19})"', r'$1.500"')
    value = F.regexp_replace(pickup, r'("tpep_dropoff_datetime":"[^"T]{10})T', "$1 ")
    return ingest.prepare(RP.decode_messages(msgs.withColumn("value", value), keep_raw=False))


@register(
    "ordered_messages",
    O.with_ctes(
        O.TRIPS_SQL,
        f"m AS (SELECT * FROM trips WHERE tpep_pickup_datetime >= TIMESTAMP '{YEAR}-{MONTH:02d}-01'"
        f" AND tpep_pickup_datetime < TIMESTAMP '{YEAR}-{MONTH + 1:02d}-01')",
        "g AS (SELECT *, CASE WHEN lag(tpep_pickup_datetime) OVER w IS NULL THEN 0.0 ELSE least((epoch_us(tpep_pickup_datetime)"
        " - epoch_us(lag(tpep_pickup_datetime) OVER w)) / 1000000 / 2.0, 10.0) END AS wait FROM m WINDOW w AS (ORDER BY tpep_pickup_datetime, "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in TRIP_COLUMNS if c != "tpep_pickup_datetime") + "))",
        body="SELECT coalesce(CAST(PULocationID AS VARCHAR), 'default') AS key, 'yellow_trip_data' AS topic,"
        " * EXCLUDE (wait), sum(wait) OVER (ORDER BY tpep_pickup_datetime, "
        + ", ".join(f"{c} ASC NULLS FIRST" for c in TRIP_COLUMNS if c != "tpep_pickup_datetime")
        + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS send_offset_seconds FROM g",
    ),
)
def q_ordered_messages(spark, sf):
    """One month's trips in pickup order, with send offsets, as messages
    (decoded again for the comparison)."""
    tie = [c for c in TRIP_COLUMNS if c != "tpep_pickup_datetime"]
    msgs = RP.ordered_messages(B.trips(spark, sf), YEAR, MONTH, tiebreak=tie)
    parsed = F.from_json(F.col("value"), RP.TRIP_SCHEMA)
    return msgs.select("key", "topic", parsed.alias("_d"), "send_offset_seconds").select("key", "topic", "_d.*", "send_offset_seconds")


_ORDER_SQL = ", ".join(f"{c} ASC NULLS FIRST" for c in TRIP_COLUMNS if c != "tpep_pickup_datetime")


@register(
    "replay_schedule",
    O.with_ctes(
        O.TRIPS_SQL,
        """p AS (SELECT *, CAST(year(tpep_pickup_datetime) AS INTEGER) AS year,
  CAST(month(tpep_pickup_datetime) AS INTEGER) AS month,
  CAST(day(tpep_pickup_datetime) AS INTEGER) AS day, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hour FROM trips)""",
        f"""g AS (SELECT *, (epoch_us(tpep_pickup_datetime) - epoch_us(lag(tpep_pickup_datetime) OVER
  (PARTITION BY year, month ORDER BY tpep_pickup_datetime ASC NULLS FIRST, {_ORDER_SQL}))) / 1000000 AS gap_seconds FROM p)""",
        "s AS (SELECT *, CASE WHEN gap_seconds IS NULL THEN 0.0 ELSE least(gap_seconds / 2.0, 10.0) END AS wait_seconds FROM g)",
        body=f"""SELECT *, sum(wait_seconds) OVER (PARTITION BY year, month ORDER BY tpep_pickup_datetime ASC NULLS FIRST,
  {_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS send_offset_seconds FROM s""",
    ),
)
def q_replay_schedule(spark, sf):
    t = TP.with_calendar(B.trips(spark, sf))
    tie = [c for c in TRIP_COLUMNS if c != "tpep_pickup_datetime"]
    return RP.replay_schedule(t, partition_by=("year", "month"), tiebreak=tie)


# ---- live timeline (W4, A4, A5, W5, J3, A7, F10, F12, G1, G2, P21, L5, L7) ------

from cabline.operators import timeline as TL  # noqa: E402


def feed(spark, sf):
    return TL.message_feed(B.events(spark, sf), "ts")


def stored_timeline(spark, sf):
    """The merged timeline (one row per distinct timestamp, so small),
    written once to the shared checkpoint folder: the chart queries anchor
    on its latest point several times, and each anchor then reads this table
    instead of re-aggregating the raw events."""
    def build():
        shared_dir(spark)
        return TL.merge_timeline(feed(spark, sf)).checkpoint(eager=True)

    return B.session_memo(spark, ("timeline", sf), build)


@register("message_feed", O.with_ctes(O.FEED_SQL, body="SELECT * FROM feed"))
def q_message_feed(spark, sf):
    return feed(spark, sf)


@register("timeline_merged", O.with_ctes(O.FEED_SQL, O.TIMELINE_SQL, body="SELECT * FROM timeline ORDER BY ts"))
def q_timeline_merged(spark, sf):
    return TL.merge_timeline(feed(spark, sf)).orderBy("ts")


@register("timeline_window", O.with_ctes(O.FEED_SQL, O.TIMELINE_SQL, body="SELECT * FROM chart ORDER BY ts"))
def q_timeline_window(spark, sf):
    return TL.chart_window(stored_timeline(spark, sf))


@register(
    "timeline_bridge",
    O.with_ctes(
        O.FEED_SQL,
        O.TIMELINE_SQL,
        body="SELECT ts, trip_count, CASE WHEN ts = (SELECT max(ts) FROM chart WHERE trip_count IS NOT NULL)"
        " THEN trip_count ELSE predicted_trip_count END AS predicted_trip_count, point_kind FROM chart ORDER BY ts",
    ),
)
def q_timeline_bridge(spark, sf):
    return TL.bridge(TL.chart_window(stored_timeline(spark, sf)))


@register(
    "time_grid",
    O.with_ctes(
        O.FEED_SQL,
        O.TIMELINE_SQL,
        body="SELECT unnest(generate_series(m - INTERVAL 60 MINUTE, m + INTERVAL 55 MINUTE, INTERVAL 5 MINUTE))"
        " AS tick FROM latest WHERE m IS NOT NULL",
    ),
)
def q_time_grid(spark, sf):
    return TL.time_grid(TL.last_actual(feed(spark, sf)).select(F.col("ts").alias("m")))


@register(
    "last_actual_point",
    O.with_ctes(
        O.FEED_SQL,
        O.TIMELINE_SQL,
        body="SELECT ts, trip_count FROM timeline WHERE trip_count IS NOT NULL ORDER BY ts DESC LIMIT 1",
    ),
)
def q_last_actual_point(spark, sf):
    """The last actual point (top-1 by time)."""
    return TL.last_actual(feed(spark, sf))


# ---- repeatable writes and scans (J4, J5, K5-K7, S1, S5, S6, S8, P12, P13) ----

from cabline.operators.joins import replace_by_key, rows_not_in, zone_role  # noqa: E402
from cabline.operators.rules import calendar_filter  # noqa: E402
from cabline.sources import trips as SRC  # noqa: E402
from cabline.sources.zones import read_zones, write_zones_csv  # noqa: E402

CUTOFF = "1998-01-01 00:00:00"
RERUN_FROM = (1997, 12)


@register(
    "merge_key_replace",
    O.with_ctes(
        *O.PROCESSED,
        O.MONTHLY_SQL,
        f"""old AS (
  SELECT year, month, count(*) AS trip_count,
    {O.r2("sum(CAST(total_amount AS DECIMAL(28,8)))")} AS total_revenue,
    {O.r2("avg(trip_distance_km)")} AS avg_distance_km,
    {O.r2("avg(trip_duration_minutes)")} AS avg_duration_minutes,
    {O.r2("avg(trip_speed_kph)")} AS avg_speed_kph
  FROM processed WHERE tpep_dropoff_datetime < TIMESTAMP '{CUTOFF}' GROUP BY year, month
)""",
        f"new AS (SELECT * FROM monthly WHERE year * 12 + month >= {RERUN_FROM[0] * 12 + RERUN_FROM[1]})",
        body="SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.year = o.year AND n.month = o.month)"
        " UNION ALL SELECT * FROM new",
    ),
)
def q_merge_key_replace(spark, sf):
    """The table as loaded before the cutoff (trips still running then are
    missing), merged with a re-run of the last loaded month and later."""
    # every processing step is per row, so the earlier load is the processed
    # rows that had ended by the cutoff (one shared plan, not a second one)
    p = processed(spark, sf)
    old = batch.monthly_analytics(p.filter(F.col("tpep_dropoff_datetime") < F.lit(CUTOFF).cast("timestamp")))
    new = stored_monthly(spark, sf).filter(
        F.col("year") * 12 + F.col("month") >= RERUN_FROM[0] * 12 + RERUN_FROM[1]
    )
    return replace_by_key(old, new, ["year", "month"])


@register(
    "dropoff_only_antijoin",
    O.with_ctes(
        *_R,
        body=f"SELECT d.* FROM routes d WHERE d.dropoff_zone = '{ZONE}' AND NOT EXISTS ("
        f"SELECT 1 FROM routes p WHERE p.pickup_zone = '{ZONE}' AND p.year = d.year AND p.month = d.month"
        " AND p.pickup_zone = d.pickup_zone AND p.dropoff_zone = d.dropoff_zone)",
    ),
)
def q_dropoff_only_antijoin(spark, sf):
    """J4 as written upstream: dropoff matches minus pickup matches by key."""
    routes = stored_routes(spark, sf)
    by_pickup = routes.filter(F.col("pickup_zone") == ZONE)
    by_dropoff = routes.filter(F.col("dropoff_zone") == ZONE)
    return rows_not_in(by_dropoff, by_pickup, ["year", "month", "pickup_zone", "dropoff_zone"])


@register("processed_rewrite", O.with_ctes(*O.PROCESSED, body="SELECT * FROM processed"))
def q_processed_rewrite(spark, sf):
    """K5: the processed trips written to a partitioned table, one month run
    again through the same sink, then read back (S7): no duplicates."""
    path = scratch_path(spark, "processed")
    p = processed(spark, sf)
    K.write_partitioned(p, path, ("year", "month"))
    again = p.filter((F.col("year") == YEAR) & (F.col("month") == MONTH))
    K.write_month(again, path, {"year": YEAR, "month": MONTH})
    return SRC.read_processed(spark, path)


@register("aggregate_rewrite", O.with_ctes(*_M, body="SELECT * FROM monthly"))
def q_aggregate_rewrite(spark, sf):
    """K7 + S8: the monthly aggregates stored twice by partition replace,
    read back from the table."""
    path = scratch_path(spark, "analyze_by_time_again")
    m = stored_monthly(spark, sf)
    K.replace_partitions(m, path)
    K.replace_partitions(m, path)
    return ST.read_aggregate(spark, path)


@register(
    "fact_table_overwrite",
    O.with_ctes(*O.PROCESSED, body=f"SELECT * FROM processed WHERE year = {YEAR} AND month = {MONTH}"),
)
def q_fact_table_overwrite(spark, sf):
    """K6: the fact table holds only the latest month written."""
    path = scratch_path(spark, "fact_trips")
    p = processed(spark, sf)
    K.write_table(p.filter((F.col("year") == YEAR - 1) & (F.col("month") == MONTH)), path)
    K.write_table(p.filter((F.col("year") == YEAR) & (F.col("month") == MONTH)), path)
    return spark.read.parquet(path)


@register(
    "source_month_scan",
    O.with_ctes(
        O.TRIPS_SQL,
        body=f"SELECT * FROM trips WHERE year(tpep_pickup_datetime) = {YEAR} AND month(tpep_pickup_datetime) = {MONTH}",
    ),
)
def q_source_month_scan(spark, sf):
    """S1 + F4: a monthly source file written by name, then opened by name."""
    root = scratch_path(spark, "source")
    month = calendar_filter(B.trips(spark, sf), "tpep_pickup_datetime", YEAR, MONTH)
    month.write.mode("overwrite").parquet(SRC.trip_file(root, "yellow", YEAR, MONTH))
    return SRC.read_trips(spark, root, "yellow", YEAR, MONTH)


@register(
    "valid_month_scan",
    O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE {O.RULE} AND year = {YEAR} AND month = {MONTH}"),
)
def q_valid_month_scan(spark, sf):
    """Valid trips stored by (year, month); one month read back through
    partition pruning."""
    root = scratch_path(spark, "raw_valid")
    valid, _ = valid_and_error(spark, sf)
    K.write_partitioned(valid, root, ("year", "month"))
    return SRC.read_valid(spark, root, YEAR, MONTH)


@register(
    "zone_scan",
    O.with_ctes(
        O.ZONES_SQL,
        body="SELECT LocationID AS PULocationID, Borough AS pickup_borough, Zone AS pickup_zone FROM zones",
    ),
)
def q_zone_scan(spark, sf):
    """S5 + P12: the zone dimension as a header CSV, scanned typed, in the
    pickup role."""
    path = scratch_path(spark, "zones_csv")
    write_zones_csv(B.zones(spark, sf), path)
    return zone_role(read_zones(spark, path), "pickup", "PULocationID")


@register(
    "parse_ts",
    O.with_ctes(
        O.TRIPS_SQL,
        """t AS (SELECT *, CASE WHEN payment_type = 7 THEN 'Other'
  ELSE strftime(tpep_pickup_datetime, '%Y-%m-%dT%H:%M:%S') END AS pickup_text FROM trips)""",
        body="SELECT * REPLACE (TRY_CAST(pickup_text AS TIMESTAMP) AS pickup_text) FROM t"
        " WHERE TRY_CAST(pickup_text AS TIMESTAMP) IS NOT NULL",
    ),
)
def q_parse_ts(spark, sf):
    """Pickup as text (unparseable for out-of-domain payment codes),
    parsed tolerantly; rows that do not parse are dropped."""
    from cabline.functions.cleaning import parse_ts

    t = B.trips(spark, sf)
    text = F.when(F.col("payment_type") == 7, F.lit("Other")).otherwise(TP.iso_text("tpep_pickup_datetime"))
    return parse_ts(t.withColumn("pickup_text", text), "pickup_text")


# ---- streaming (S3, S4, T1-T5, T9, K2-K4, K8, A8) over file streams --------------

from cabline.schema import MESSAGE_SCHEMA  # noqa: E402
from cabline.streaming import ingest as SI  # noqa: E402
from cabline.streaming import live as SL  # noqa: E402

#: Micro-batches that a topic takes at least, bytes of messages as stored that one takes at most, and messages of a file.
BATCHES, BYTES_PER_TRIGGER, FILE_MESSAGES = 3, 8 << 30, 500_000


def messages_per_file(spark, sf) -> int:
    """So many that a topic of all trips has enough files for every core in
    every micro-batch; the footers' row count sizes them."""
    files = BATCHES * max(2, spark.sparkContext.defaultParallelism)
    return min(FILE_MESSAGES, max(1, B.table(spark, sf, "lineitem").count() // files))


def publish_messages(spark, sf) -> str:
    """K1 to a message folder (the file twin of the topic), once per session
    and scale factor. The messages are the widest form of the rows, so they
    are packed and never shuffled."""
    from cabline.sinks.messages import MessageTarget, write_messages

    def write():
        topic = scratch_path(spark, "topic")
        msgs = RP.to_messages(B.trips(spark, sf))
        write_messages(msgs, MessageTarget(format="text", path=topic), rows_per_file=messages_per_file(spark, sf))
        return topic

    return B.session_memo(spark, ("topic", sf), write)


def parsed_stream(spark, sf):
    topic = publish_messages(spark, sf)
    per_batch = min(BYTES_PER_TRIGGER, max(1, folder_bytes(spark, topic) // BATCHES))
    src = SI.StreamSource(format="text", path=topic, max_bytes_per_trigger=per_batch)
    return SI.parse_stream(SI.read_trip_stream(spark, src))


def run_store(spark, sf, side: str) -> str:
    """One storage query (K2 valid or K3 error) over the message stream."""
    base = scratch_path(spark, "stream")
    valid, error = SI.split_stream(parsed_stream(spark, sf))
    q = SI.start_parquet_sink(
        valid if side == "valid" else error, f"{base}/{side}", f"{base}/ckpt-{side}",
        partition_cols=("year", "month"), available_now=True,
    )
    q.awaitTermination()
    return f"{base}/{side}"


@register("stream_valid", O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE {O.RULE}"))
def q_stream_valid(spark, sf):
    return spark.read.parquet(run_store(spark, sf, "valid"))


@register(
    "stream_error",
    O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE NOT coalesce({O.RULE}, false)"),
)
def q_stream_error(spark, sf):
    return spark.read.parquet(run_store(spark, sf, "error")).drop("_raw")


def run_live(spark, sf, model=None) -> tuple[str, str]:
    base = scratch_path(spark, "live")
    valid, _ = SI.split_stream(parsed_stream(spark, sf))
    sink = SL.LiveSink(f"{base}/state", f"{base}/messages", model=model)
    q = SI.start_foreach_batch(valid, sink, f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return f"{base}/state", f"{base}/messages"


@register(
    "stream_running_total",
    O.with_ctes(*O.BASE, body=f"SELECT count(*) AS total FROM prepared WHERE {O.RULE}"),
)
def q_stream_running_total(spark, sf):
    state, _ = run_live(spark, sf)
    return spark.read.parquet(state).orderBy(F.col("batch_id").desc()).limit(1).select("total")


@register(
    "stream_live_counts",
    O.with_ctes(
        *O.BASE,
        f"""v AS (SELECT p.*, z.Borough AS pickup_borough FROM prepared p
  LEFT JOIN zones z ON p.PULocationID = z.LocationID WHERE {O.RULE})""",
        body="SELECT pickup_borough, count(*) AS trip_count FROM v GROUP BY pickup_borough",
    ),
)
def q_stream_live_counts(spark, sf):
    base = scratch_path(spark, "livecounts")
    valid, _ = SI.split_stream(parsed_stream(spark, sf))
    counts = SL.live_counts_frame(valid, B.zones(spark, sf))
    q = SI.start_foreach_batch(counts, SL.overwrite_sink(f"{base}/out"), f"{base}/ckpt",
                               available_now=True, output_mode="complete")
    q.awaitTermination()
    return SL.read_latest(spark, f"{base}/out")


@register("timeline_upsert", O.with_ctes(O.FEED_SQL, O.TIMELINE_SQL, body="SELECT * FROM timeline"))
def q_timeline_upsert(spark, sf):
    """Real-time messages arrive as a stream in several batches, each of
    which upserts the stored timeline."""
    from pyspark.sql.types import LongType, StructField, StructType

    base = scratch_path(spark, "timeline")
    feed(spark, sf).repartitionByRange(4, "seq").write.mode("overwrite").json(f"{base}/topic")
    schema = StructType([StructField("seq", LongType(), True)] + MESSAGE_SCHEMA.fields)
    # the feed is one row per 15 minutes, so its files are few; two of them make a batch
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(f"{base}/topic")
    q = SI.start_foreach_batch(stream, SL.TimelineSink(f"{base}/timeline"), f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    return SL.read_latest(spark, f"{base}/timeline").select("ts", "trip_count", "predicted_trip_count")


_SERVING_SQL = """f AS (SELECT seq, max_pickup_time,
  CAST(sum(batch_trip_count) OVER (PARTITION BY seq // 3600 ORDER BY seq) AS BIGINT) AS trip_count,
  max_pickup_time + INTERVAL 1 HOUR AS n FROM batches)"""


@register(
    "serving_features",
    O.with_ctes(
        O.FEED_SQL,
        _SERVING_SQL,
        body="SELECT seq, max_pickup_time, trip_count, CAST(hour(n) AS INTEGER) AS hour,"
        " CAST(dayofweek(n) + 1 AS INTEGER) AS day_of_week, CAST(dayofweek(n) IN (0, 6) AS INTEGER) AS is_weekend FROM f",
    ),
)
def q_serving_features(spark, sf):
    """The model's features one hour ahead, for every event-time batch."""
    return FC.batch_features(B.events(spark, sf), "ts")


@register(
    "forecast_next_hour",
    O.with_ctes(
        *O.BASE,
        f"v AS (SELECT count(*) AS n, max(tpep_pickup_datetime) AS m FROM prepared WHERE {O.RULE})",
        body="SELECT n AS trip_count, strftime(m, '%Y-%m-%d %H:%M:%S') AS timestamp,"
        " strftime(m + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS predicted_timestamp, true AS within_labels,"
        " true AS whole_and_added, true AS same_after_load, CAST(20 AS INTEGER) AS trees FROM v",
    ),
)
def q_forecast_next_hour(spark, sf):
    """Train on the labelled hourly
    history, save and reload the model, then score the next hour after every
    live micro-batch. The messages are reduced to what must hold of them: the
    final total and times; every prediction within the labels the forest saw
    (an average of them), truncated to a whole count and added to the total;
    the loaded model predicting what the fitted one does; 20 trees."""
    train = K.write_and_read(FC.add_label(FC.hourly_series(processed(spark, sf)), gap="grid"), scratch_path(spark, "train"))
    model = FC.fit_forecast(train)
    path = scratch_path(spark, "model")
    K.save_model(model, path)
    loaded = ST.load_model(path)
    both = model.transform(train).select("pickup_hour", F.col("prediction").alias("p")).join(
        loaded.transform(train).select("pickup_hour", F.col("prediction").alias("q")), "pickup_hour"
    )
    same = both.agg(F.bool_and(F.col("p").eqNullSafe(F.col("q"))).alias("same_after_load"))
    labels = train.agg(F.floor(F.min("future_trip_count")).alias("lo"), F.max("future_trip_count").alias("hi"))
    state, messages = run_live(spark, sf, model=loaded)
    # the last state says once more what its message must have added
    last = spark.read.schema(SL.STATE_SCHEMA).parquet(state).where("batch_trip_count > 0").orderBy(F.col("batch_id").desc()).limit(1)
    scored = loaded.transform(FC.serving_features(last, "max_pickup_time", "hour_count"))
    want = scored.select((F.floor("prediction") + F.col("total")).cast("long").alias("want"), F.lit(1).alias("one"))
    msgs = spark.read.parquet(messages)
    added = F.col("predicted_trip_count") - F.col("trip_count")
    m = msgs.join(labels.withColumn("one", F.lit(1)), F.col("one") == 1).agg(
        F.max("trip_count").alias("trip_count"), F.max("timestamp").alias("timestamp"),
        F.max("predicted_timestamp").alias("predicted_timestamp"), F.bool_and(added.between(F.col("lo"), F.col("hi"))).alias("within_labels"),
        F.max_by("predicted_trip_count", "trip_count").alias("final"), F.lit(1).alias("one"),
    )
    out = m.join(want, "one").join(same.withColumn("one", F.lit(1)), "one")
    return out.select(
        "trip_count", "timestamp", "predicted_timestamp", "within_labels", (F.col("final") == F.col("want")).alias("whole_and_added"),
        "same_after_load", F.lit(len(loaded.stages[-1].trees)).cast("int").alias("trees"),
    )


@register(
    "stream_storage",
    O.with_ctes(
        *O.BASE,
        body=f"SELECT 'valid' AS store, * FROM prepared WHERE {O.RULE} UNION ALL"
        f" SELECT 'error' AS store, * FROM prepared WHERE NOT coalesce({O.RULE}, false)",
    ),
)
def q_stream_storage(spark, sf):
    """Valid store, error store and live sink as three queries over one
    stream, run together; both stores read back."""
    base = scratch_path(spark, "storage")
    parsed = parsed_stream(spark, sf)
    valid, _ = SI.split_stream(parsed)
    queries = [
        *SI.start_storage(parsed, f"{base}/valid", f"{base}/error", f"{base}/ckpt", ("year", "month"), available_now=True),
        SI.start_foreach_batch(valid, SL.LiveSink(f"{base}/state", f"{base}/messages"), f"{base}/ckpt/live", available_now=True),
    ]
    for q in queries:
        q.awaitTermination()
    stores = {k: spark.read.parquet(f"{base}/{k}").drop("_raw") for k in ("valid", "error")}
    return stores["valid"].withColumn("store", F.lit("valid")).unionByName(stores["error"].withColumn("store", F.lit("error")))


@register(
    "stream_live_top_zones",
    O.with_ctes(
        *O.BASE,
        f"""v AS (SELECT p.*, z.Zone AS pickup_zone FROM prepared p
  LEFT JOIN zones z ON p.PULocationID = z.LocationID WHERE {O.RULE})""",
        body="SELECT pickup_zone, count(*) AS trip_count FROM v GROUP BY pickup_zone"
        " ORDER BY trip_count DESC, pickup_zone ASC NULLS FIRST LIMIT 10",
    ),
)
def q_stream_live_top_zones(spark, sf):
    """A8 by pickup zone: running counts in complete mode, then the top 10
    (ties by zone name)."""
    base = scratch_path(spark, "livezones")
    valid, _ = SI.split_stream(parsed_stream(spark, sf))
    counts = SL.live_counts_frame(valid, B.zones(spark, sf), dim="pickup_zone")
    q = SI.start_foreach_batch(counts, SL.overwrite_sink(f"{base}/out"), f"{base}/ckpt",
                               available_now=True, output_mode="complete")
    q.awaitTermination()
    return SL.top_k(SL.read_latest(spark, f"{base}/out"), k=10, tie="pickup_zone")


# ---- paging by order statistics, mergeable aggregates, keyed state, fan-out ------

from cabline.operators import mergeable as MG  # noqa: E402
from cabline.operators import paging as PG  # noqa: E402
from cabline.operators import zone_store as ZS  # noqa: E402
from cabline.streaming import fanout as FO  # noqa: E402
from cabline.streaming import keyed as KS  # noqa: E402


@register(
    "trip_page_deep",
    O.with_ctes(
        O.TRIPS_SQL,
        "n AS (SELECT count(*) AS total FROM trips)",
        "r AS (SELECT *, row_number() OVER (ORDER BY " + ", ".join(f"{c} ASC NULLS FIRST" for c in _ORDER_COLS) + ") - 1 AS pos FROM trips)",
        body=f"SELECT {_page_select()}, total FROM r, n WHERE pos >= total * 2 // 3 AND pos < total * 2 // 3 + {_PAGE_LIMIT}",
    ),
)
def q_trip_page_deep(spark, sf):
    """L1 + A6 beyond half of all trips: only the partitions that hold the page are opened."""
    from cabline.functions.cleaning import null_non_finite

    path = scratch_path(spark, "pages")
    PG.write_page_index(B.trips(spark, sf), _ORDER_COLS, path, partitions=32)
    offset = PG.page_total(spark, path) * 2 // 3
    return S.format_timestamps(null_non_finite(PG.page_at(spark, path, offset, _PAGE_LIMIT)))


def _incremental(spark, sf, table) -> DataFrame:
    """The trips that had ended by the cutoff, with one month too high; the
    late ones as a load that runs twice; the month corrected; another compacted."""
    path = scratch_path(spark, "states")
    needed = dict.fromkeys((*table[0], "tpep_dropoff_datetime", "total_amount", *table[1].values()))
    p = K.write_and_read(processed(spark, sf).select(*needed), scratch_path(spark, "loads"))  # every load reads the trips as stored
    ended = F.col("tpep_dropoff_datetime") < F.lit(CUTOFF).cast("timestamp")
    wrong = (F.col("year") == YEAR) & (F.col("month") == MONTH)
    MG.write_load(p.where(ended).withColumn("total_amount", F.when(wrong, F.col("total_amount") * 2).otherwise(F.col("total_amount"))), path, "first", table)
    for _ in range(2):
        MG.write_load(p.where(~ended), path, "late", table)
    MG.replace_month(p, path, YEAR, MONTH, "corrected", table)
    MG.compact(spark, path, RERUN_FROM[0], RERUN_FROM[1], "one", table)
    return MG.finished(MG.read_states(spark, path, table), table)


@register("monthly_incremental", O.with_ctes(*_M, body="SELECT * FROM monthly"))
def q_monthly_incremental(spark, sf):
    """A1 + K7 from stored states: late trips and a corrected month, nothing else computed again."""
    return _incremental(spark, sf, MG.MONTHLY)


@register("route_incremental", O.with_ctes(*_R, body="SELECT * FROM routes"))
def q_route_incremental(spark, sf):
    """A2 + K7 from stored states."""
    return _incremental(spark, sf, MG.ROUTES)


IDLE_SECONDS = 1800


@register(
    "stream_idle_total",
    O.with_ctes(
        *O.BASE,
        f"v AS (SELECT tpep_pickup_datetime AS t FROM prepared WHERE {O.RULE})",
        f"g AS (SELECT t, CASE WHEN t - lag(t) OVER (ORDER BY t) <= to_seconds({IDLE_SECONDS}) THEN 0 ELSE 1 END AS starts FROM v)",
        "s AS (SELECT t, sum(starts) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)",
        body="SELECT min(t) AS first_arrival, max(t) AS last_arrival, count(*) AS total FROM s GROUP BY session",
    ),
)
def q_stream_idle_total(spark, sf):
    """T5 in Spark's state over several micro-batches: the running total of
    every stretch without a pause, with the pickup time as the clock, so
    totals expire many times."""
    base = scratch_path(spark, "idle")
    valid, _ = SI.split_stream(parsed_stream(spark, sf))
    totals = KS.running_totals(valid, ttl_seconds=IDLE_SECONDS, arrival=F.col("tpep_pickup_datetime"))
    with KS.state_settings(spark):
        q = SI.start_foreach_batch(totals, SL.overwrite_sink(f"{base}/out"), f"{base}/ckpt", available_now=True, output_mode="complete")
    q.awaitTermination()
    return SL.read_latest(spark, f"{base}/out").select("first_arrival", "last_arrival", "total")


@register("timeline_log", O.with_ctes(O.FEED_SQL, O.TIMELINE_SQL, body="SELECT * FROM timeline"))
def q_timeline_log(spark, sf):
    """T9 in Spark's state: every micro-batch emits the points that it touches; the log of them folded."""
    from pyspark.sql.types import LongType, StructField, StructType

    base = scratch_path(spark, "timelinelog")
    feed(spark, sf).repartitionByRange(4, "seq").write.mode("overwrite").json(f"{base}/topic")
    schema = StructType([StructField("seq", LongType(), True)] + MESSAGE_SCHEMA.fields)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{base}/topic")
    with KS.state_settings(spark):
        q = SI.start_foreach_batch(KS.timeline_changes(stream), KS.ChangeLog(f"{base}/log"), f"{base}/ckpt", available_now=True, output_mode="update")
    q.awaitTermination()
    return KS.read_log(spark, f"{base}/log", "ts", KS.POINT_COLUMNS).select("ts", "trip_count", "predicted_trip_count")


@register(
    "stream_fan_out",
    O.with_ctes(
        *O.BASE,
        body=f"SELECT 'valid' AS store, * FROM prepared WHERE {O.RULE} UNION ALL"
        f" SELECT 'error' AS store, * FROM prepared WHERE NOT coalesce({O.RULE}, false)",
    ),
)
def q_stream_fan_out(spark, sf):
    """T1 with one read of the source: both stores and the live state from one query, by committed batches."""
    base = scratch_path(spark, "fanout")
    handler = FO.FanOut(f"{base}/stores", SL.LiveSink(f"{base}/state", f"{base}/messages"))
    q = SI.start_foreach_batch(parsed_stream(spark, sf), handler, f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    valid, error = (FO.read_store(spark, f"{base}/stores", k) for k in ("valid", "error"))
    return valid.withColumn("store", F.lit("valid")).unionByName(error.drop("_raw").withColumn("store", F.lit("error")))


def zone_store(spark, sf) -> str:
    def write():
        path = scratch_path(spark, "zone_store")
        ZS.write_zone_store(stored_routes(spark, sf), path)
        return path

    return B.session_memo(spark, ("zone_store", sf), write)


@register("routes_by_zone_clustered", ORACLE["routes_by_zone"])
def q_routes_by_zone_clustered(spark, sf):
    """U1 + F6 on the zone-clustered table: a request opens one of its folders."""
    return ZS.zone_routes(spark, zone_store(spark, sf), ZONE)


@register("top_pickups_clustered", ORACLE["top_pickups"])
def q_top_pickups_clustered(spark, sf):
    """L3 on the zone-clustered table."""
    return ZS.zone_top(spark, zone_store(spark, sf), ZONE, YEAR, MONTH, "pickup")


# ---- months of drifting types, hours as a stream ---------------------------------

from cabline.sources import months as MO  # noqa: E402
from cabline.streaming import hourly as HS  # noqa: E402


@register(
    "drifting_months",
    O.with_ctes(
        O.TRIPS_SQL,
        body="SELECT * REPLACE (CASE WHEN month(tpep_pickup_datetime) % 4 = 3 THEN NULL ELSE passenger_count END AS passenger_count)"
        " FROM trips WHERE tpep_pickup_datetime IS NOT NULL",
    ),
)
def q_drifting_months(spark, sf):
    """S1 + S2 over all months: the passenger count is INT, BIGINT, DOUBLE or
    absent, another column spelled otherwise in some, and some are all text.
    The trips are stored by kind once, so that not every kind joins them again."""
    root = scratch_path(spark, "months")
    t = TP.with_calendar(B.trips(spark, sf).where("tpep_pickup_datetime IS NOT NULL")).drop("day", "hour")
    kind = t.withColumn("kind", F.col("month") % 4)
    whole = scratch_path(spark, "kinds")
    kind.write.mode("overwrite").partitionBy("kind").parquet(whole)
    kind = spark.read.schema(kind.schema).parquet(whole)
    forms = [
        lambda d: d,
        lambda d: d.withColumn("passenger_count", F.col("passenger_count").cast("long")).withColumnRenamed("airport_fee", "Airport_fee"),
        lambda d: d.withColumn("passenger_count", F.col("passenger_count").cast("double")),
        lambda d: d.select(*[F.col(c).cast("string").alias(c) if c in TRIP_COLUMNS else F.col(c) for c in d.columns if c != "passenger_count"]),
    ]
    for k, form in enumerate(forms):
        K.write_partitioned(form(kind.where(F.col("kind") == k).drop("kind")), f"{root}/{k}", ("year", "month"))
    paths = [f"{root}/{k}/{y}/{m}" for k in range(4) for y in child_names(spark, f"{root}/{k}") if "=" in y for m in child_names(spark, f"{root}/{k}/{y}") if "=" in m]
    return null_non_finite(MO.read_drifting(spark, paths))


LATE_TYPE, LATENESS_HOURS = 4, 24


@register(
    "stream_hourly_counts",
    O.with_ctes(
        *O.PROCESSED,
        "p AS (SELECT tpep_pickup_datetime AS t, date_trunc('hour', tpep_pickup_datetime) AS pickup_hour,"
        f" coalesce(payment_type = {LATE_TYPE}, false) AS second FROM processed)",
        f"w AS (SELECT max(t) FILTER (NOT second) - INTERVAL {LATENESS_HOURS} HOUR AS w1, max(t) - INTERVAL {LATENESS_HOURS} HOUR AS w2 FROM p)",
        "h AS (SELECT pickup_hour, count(*) FILTER (NOT (second AND pickup_hour + INTERVAL 1 HOUR <= w1)) AS trip_count,"
        " count(*) FILTER (second AND pickup_hour + INTERVAL 1 HOUR <= w1) AS late FROM p, w GROUP BY 1, w1, w2)",
        "c AS (SELECT max(pickup_hour) AS newest FROM h, w WHERE trip_count > 0 AND pickup_hour + INTERVAL 1 HOUR <= w2)",
        body="SELECT h.* FROM h, c WHERE pickup_hour <= newest",
    ),
)
def q_stream_hourly_counts(spark, sf):
    """A3 as a stream over several micro-batches: hours closed by the
    watermark, the query started again between them. The trips of one payment
    type come after all others, so those of hours closed by then are late.
    The trips are stored, as each part is a pass over them, until the last is
    published; messages are packed, as they are ten times as wide."""
    from cabline.sinks.messages import MessageTarget, write_messages

    base = scratch_path(spark, "hourly")
    trips = K.write_and_read(B.trips(spark, sf), f"{base}/trips")
    second = F.coalesce(F.col("payment_type") == LATE_TYPE, F.lit(False))
    t = F.unix_micros("tpep_pickup_datetime")
    middle = trips.where(~second).agg(((F.min(t) + F.max(t)) / 2).cast("long")).first()[0] or 0
    early = F.coalesce(t < middle, F.lit(False))
    parts = [trips.where(~second & early), trips.where(~second & ~early), trips.where(second)]
    rows = messages_per_file(spark, sf)
    for i, part in enumerate(parts):  # published and taken one after the other
        write_messages(RP.to_messages(part), MessageTarget(format="text", path=f"{base}/topic/{i}"), rows_per_file=rows)
        if part is parts[-1]:
            remove_path(spark, f"{base}/trips")
        src = SI.StreamSource(format="text", path=f"{base}/topic/*")
        valid, _ = SI.split_stream(SI.parse_stream(SI.read_trip_stream(spark, src), keep_raw=False))
        for q in HS.start_hourly(batch.process(valid, B.zones(spark, sf)), f"{base}/hours", f"{base}/ckpt", lateness=f"{LATENESS_HOURS} hours", available_now=True):
            q.awaitTermination()
    return HS.read_hours(spark, f"{base}/hours")


# ---- messages by offset ------------------------------------------------------------

from cabline.streaming import message_log as ML  # noqa: E402

_LATER = "coalesce(payment_type >= 3, false)"


@register(
    "stream_log_offsets",
    O.with_ctes(
        *O.BASE,
        body="SELECT 'all' AS start, * FROM prepared UNION ALL"
        f" SELECT s.start, p.* FROM prepared p CROSS JOIN (VALUES ('latest'), ('given'), ('lost')) s(start) WHERE {_LATER}",
    ),
)
def q_stream_log_offsets(spark, sf):
    """S3 + T4 by offset: a query that began at the end of the first messages,
    one from given offsets, one from the first that are left when the earlier
    are gone, and all messages before that. The trips are stored, as each
    append is a pass over them, until the last; the log until the last read."""
    base = scratch_path(spark, "log")
    log, trips = f"{base}/log", K.write_and_read(B.trips(spark, sf), f"{base}/trips")

    def take(name: str, start: str):
        src = SI.StreamSource(format="log", path=log, position=f"{base}/{name}/position", starting_offsets=start)
        parsed = SI.parse_stream(SI.read_trip_stream(spark, src), keep_raw=False)
        SI.start_foreach_batch(parsed, KS.ChangeLog(f"{base}/{name}/out"), f"{base}/{name}/ckpt", available_now=True).awaitTermination()

    later = F.expr(_LATER)
    ML.append_messages(RP.to_messages(trips.where(~later)), log, "topic", 0)
    take("latest", "latest")
    ends = ML.Log(log).newest()["ends"]
    for _ in range(2):  # an append that runs again changes nothing
        ML.append_messages(RP.to_messages(trips.where(later)), log, "topic", 1)
    remove_path(spark, f"{base}/trips")
    take("latest", "latest")
    take("given", json.dumps({str(p): x for p, x in enumerate(ends)}))
    take("all", "earliest")
    ML.Log(log).trim(dict(enumerate(ends)))
    take("lost", json.dumps({str(p): 0 for p in range(len(ends))}))
    remove_path(spark, log)
    out = [spark.read.schema(RULED).parquet(f"{base}/{n}/out").drop("batch_id").withColumn("start", F.lit(n)) for n in ("all", "latest", "given", "lost")]
    return reduce(DataFrame.unionByName, out)


RULED = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TRIP_SCHEMA.fields) + ", year int, month int, day int, hour int"


@register("message_relay", O.with_ctes(*O.BASE, body="SELECT * FROM prepared"))
def q_message_relay(spark, sf):
    """K1 + K8 with commits: the messages of one log published in another by a
    stream, whose batch then runs again as after a lost driver; each is there once."""
    base = scratch_path(spark, "relay")
    ML.append_messages(RP.to_messages(B.trips(spark, sf)), f"{base}/log")
    src = SI.StreamSource(format="log", path=f"{base}/log", position=f"{base}/position", starting_offsets="earliest")
    for again in (False, True):
        if again:
            remove_path(spark, f"{base}/ckpt/commits")
        SI.start_message_sink(SI.read_trip_stream(spark, src), f"{base}/copy", f"{base}/ckpt", "relay", available_now=True).awaitTermination()
    return ingest.prepare(RP.decode_messages(ML.read_messages(spark, f"{base}/copy"), keep_raw=False))


# ---- compaction of the stores --------------------------------------------------------

from cabline.sinks import compaction as CO  # noqa: E402


@register("stream_compacted", O.with_ctes(*O.BASE, body=f"SELECT * FROM prepared WHERE {O.RULE}"))
def q_stream_compacted(spark, sf):
    """K2 rewritten: the valid store of several micro-batches into few files
    per partition, read through the newest manifest."""
    path = run_store(spark, sf, "valid")
    out = f"{path}-compacted"
    CO.compact(spark, path, out, ("year", "month"))
    return CO.read_compacted(spark, path, out)
