"""DuckDB SQL twins of the registered queries.

Each string runs on the test tables registered as views. Shared CTEs build
the same trip binding, ingest split and processing as the Spark code.
Rounding is half-up on the value fixed to 8 decimals, as in
``cabline.functions.measures.round_half_up``.
"""

from __future__ import annotations

from cabline.sources.bindings import TRIPS_SQL, ZONES_SQL


def r2(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), 2) AS DOUBLE)"


RULE = (
    "(tpep_pickup_datetime IS NOT NULL AND tpep_dropoff_datetime IS NOT NULL"
    " AND tpep_dropoff_datetime > tpep_pickup_datetime"
    " AND passenger_count IS NOT NULL AND RatecodeID IS NOT NULL"
    " AND trip_distance > 0 AND fare_amount >= 0 AND total_amount >= 0"
    " AND PULocationID BETWEEN 1 AND 263 AND DOLocationID BETWEEN 1 AND 263"
    " AND store_and_fwd_flag IN ('Y', 'N') AND payment_type IN (0, 1, 2, 3, 4, 5, 6))"
)

PREPARED_SQL = """
prepared AS (
  SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime,
    coalesce(passenger_count, 1) AS passenger_count, trip_distance,
    coalesce(RatecodeID, 99.0) AS RatecodeID, coalesce(store_and_fwd_flag, 'N') AS store_and_fwd_flag,
    PULocationID, DOLocationID, payment_type, fare_amount, extra, mta_tax, tip_amount,
    tolls_amount, improvement_surcharge, total_amount,
    coalesce(congestion_surcharge, 0.0) AS congestion_surcharge, coalesce(airport_fee, 0.0) AS airport_fee,
    CAST(year(tpep_pickup_datetime) AS INTEGER) AS year, CAST(month(tpep_pickup_datetime) AS INTEGER) AS month,
    CAST(day(tpep_pickup_datetime) AS INTEGER) AS day, CAST(hour(tpep_pickup_datetime) AS INTEGER) AS hour
  FROM trips
)"""

PAYMENT_CASE = (
    "CASE payment_type WHEN 0 THEN 'Flex Fare trip' WHEN 1 THEN 'Credit card' WHEN 2 THEN 'Cash'"
    " WHEN 3 THEN 'No charge' WHEN 4 THEN 'Dispute' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Voided trip'"
    " ELSE 'Other' END"
)

ENRICHED_SQL = f"""
valid AS (SELECT * FROM prepared WHERE {RULE}),
enriched0 AS (
  SELECT v.*, pz.Borough AS pickup_borough, pz.Zone AS pickup_zone,
    dz.Borough AS dropoff_borough, dz.Zone AS dropoff_zone,
    printf('%02d:00', v.hour) AS hour_label,
    {PAYMENT_CASE} AS payment_type_name,
    {r2("v.trip_distance * CAST(1.60934 AS DOUBLE)")} AS trip_distance_km,
    {r2("(floor(epoch(v.tpep_dropoff_datetime)) - floor(epoch(v.tpep_pickup_datetime))) / 60")} AS trip_duration_minutes,
    strftime(v.tpep_pickup_datetime, '%A') AS day_of_week,
    strftime(v.tpep_pickup_datetime, '%m/%Y') AS month_label
  FROM valid v
  LEFT JOIN zones pz ON v.PULocationID = pz.LocationID
  LEFT JOIN zones dz ON v.DOLocationID = dz.LocationID
),
enriched AS (
  SELECT *, {r2("trip_distance_km / (trip_duration_minutes / 60)")} AS trip_speed_kph FROM enriched0
),
processed AS (
  SELECT * FROM enriched
  WHERE trip_speed_kph > 5 AND trip_speed_kph < 120 AND trip_distance_km <= 160
)"""

MONTHLY_SQL = f"""
monthly AS (
  SELECT year, month, count(*) AS trip_count,
    {r2("sum(CAST(total_amount AS DECIMAL(28,8)))")} AS total_revenue,
    {r2("avg(trip_distance_km)")} AS avg_distance_km,
    {r2("avg(trip_duration_minutes)")} AS avg_duration_minutes,
    {r2("avg(trip_speed_kph)")} AS avg_speed_kph
  FROM processed GROUP BY year, month
)"""

ROUTES_SQL = f"""
routes AS (
  SELECT year, month, pickup_zone, dropoff_zone, count(*) AS trip_count,
    {r2("avg(trip_distance_km)")} AS avg_distance_km,
    {r2("avg(trip_duration_minutes)")} AS avg_duration_minutes,
    {r2("avg(fare_amount)")} AS avg_fare,
    {r2("sum(CAST(total_amount AS DECIMAL(28,8)))")} AS total_revenue
  FROM processed GROUP BY year, month, pickup_zone, dropoff_zone
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


BASE = (TRIPS_SQL, ZONES_SQL, PREPARED_SQL)
PROCESSED = BASE + (ENRICHED_SQL,)


def r1(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,8)), 1) AS DOUBLE)"


def top_sql(direction: str, year: int, month: int, zone: str, k: int = 5) -> str:
    key, other = (("pickup_zone", "dropoff_zone") if direction == "pickup" else ("dropoff_zone", "pickup_zone"))
    return (
        f"SELECT *, '{direction}s' AS direction,"
        f" CAST(row_number() OVER (ORDER BY trip_count DESC, {other} ASC NULLS FIRST) AS INTEGER) AS rank"
        f" FROM (SELECT * FROM routes WHERE year = {year} AND month = {month} AND {key} = '{zone}'"
        f" ORDER BY trip_count DESC, {other} ASC NULLS FIRST LIMIT {k})"
    )


def top_all_sql(direction: str, k: int = 5) -> str:
    key, other = (("pickup_zone", "dropoff_zone") if direction == "pickup" else ("dropoff_zone", "pickup_zone"))
    return (
        f"SELECT *, '{direction}s' AS direction, {key} AS zone FROM ("
        f"SELECT *, CAST(row_number() OVER (PARTITION BY year, month, {key}"
        f" ORDER BY trip_count DESC, {other} ASC NULLS FIRST) AS INTEGER) AS rank"
        f" FROM routes WHERE {key} IS NOT NULL) WHERE rank <= {k}"
    )


FILLED_SQL = """
filled AS (
  SELECT VendorID, tpep_pickup_datetime, tpep_dropoff_datetime,
    coalesce(passenger_count, 1) AS passenger_count, trip_distance,
    coalesce(RatecodeID, 99.0) AS RatecodeID, coalesce(store_and_fwd_flag, 'N') AS store_and_fwd_flag,
    PULocationID, DOLocationID, payment_type, fare_amount, extra, mta_tax, tip_amount,
    tolls_amount, improvement_surcharge, total_amount,
    coalesce(congestion_surcharge, 0.0) AS congestion_surcharge, coalesce(airport_fee, 0.0) AS airport_fee
  FROM trips
)"""

HOURLY_SQL = """
hourly AS (
  SELECT pickup_hour, trip_count, CAST(hour(pickup_hour) AS INTEGER) AS hour,
    CAST(dayofweek(pickup_hour) + 1 AS INTEGER) AS day_of_week,
    CAST(dayofweek(pickup_hour) IN (0, 6) AS INTEGER) AS is_weekend
  FROM (SELECT date_trunc('hour', tpep_pickup_datetime) AS pickup_hour, count(*) AS trip_count
        FROM processed GROUP BY 1)
)"""


FEED_SQL = """
batches AS (
  SELECT (epoch_us(ts) // 900000000) * 900 AS seq, max(ts) AS max_pickup_time, count(*) AS batch_trip_count
  FROM events GROUP BY 1
),
feed AS (
  SELECT seq, strftime(max_pickup_time, '%Y-%m-%d %H:%M:%S') AS timestamp,
    CAST(sum(batch_trip_count) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS trip_count,
    strftime(max_pickup_time + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS predicted_timestamp,
    CAST(sum(batch_trip_count) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         + batch_trip_count * 4 AS BIGINT) AS predicted_trip_count
  FROM batches
)"""

TIMELINE_SQL = """
actual AS (SELECT strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS ts, arg_max(trip_count, seq) AS trip_count
           FROM feed GROUP BY 1),
predicted AS (SELECT strptime(predicted_timestamp, '%Y-%m-%d %H:%M:%S') AS ts,
                     arg_max(predicted_trip_count, seq) AS predicted_trip_count FROM feed GROUP BY 1),
timeline AS (SELECT coalesce(a.ts, p.ts) AS ts, a.trip_count, p.predicted_trip_count
             FROM actual a FULL OUTER JOIN predicted p ON a.ts = p.ts),
latest AS (SELECT max(ts) AS m FROM timeline WHERE trip_count IS NOT NULL),
chart AS (
  SELECT t.*, CASE WHEN t.ts > (SELECT m FROM latest) THEN 'predicted' ELSE 'actual' END AS point_kind
  FROM timeline t
  WHERE t.ts BETWEEN (SELECT m FROM latest) - INTERVAL 60 MINUTE AND (SELECT m FROM latest) + INTERVAL 60 MINUTE
    AND (t.trip_count IS NOT NULL OR t.predicted_trip_count IS NOT NULL)
)"""
