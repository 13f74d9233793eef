"""Schemas, code maps and rule constants shared by batch and streaming code.

Everything that must equal the upstream trip platform for results to match
is collected here, in natural order, under the FIXED VALUES markers.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the upstream platform for identical results)
# ---------------------------------------------------------------------------

# The standard trip record: 19 nullable columns, in this order.
TRIP_SCHEMA = StructType(
    [
        StructField("VendorID", IntegerType(), True),
        StructField("tpep_pickup_datetime", TimestampType(), True),
        StructField("tpep_dropoff_datetime", TimestampType(), True),
        StructField("passenger_count", IntegerType(), True),
        StructField("trip_distance", DoubleType(), True),
        StructField("RatecodeID", DoubleType(), True),
        StructField("store_and_fwd_flag", StringType(), True),
        StructField("PULocationID", IntegerType(), True),
        StructField("DOLocationID", IntegerType(), True),
        StructField("payment_type", IntegerType(), True),
        StructField("fare_amount", DoubleType(), True),
        StructField("extra", DoubleType(), True),
        StructField("mta_tax", DoubleType(), True),
        StructField("tip_amount", DoubleType(), True),
        StructField("tolls_amount", DoubleType(), True),
        StructField("improvement_surcharge", DoubleType(), True),
        StructField("total_amount", DoubleType(), True),
        StructField("congestion_surcharge", DoubleType(), True),
        StructField("airport_fee", DoubleType(), True),
    ]
)

# Source column spellings that differ from the standard schema.
SOURCE_RENAMES = {
    "Airport_fee": "airport_fee",
    "lpep_pickup_datetime": "tpep_pickup_datetime",
    "lpep_dropoff_datetime": "tpep_dropoff_datetime",
}

# Values filled in for nulls right after parsing.
TRIP_DEFAULTS = {
    "passenger_count": 1,
    "airport_fee": 0.0,
    "congestion_surcharge": 0.0,
    "store_and_fwd_flag": "N",
    "RatecodeID": 99,
}

# Validity domain.
LOCATION_MIN, LOCATION_MAX = 1, 263
VALID_FLAGS = ("Y", "N")
VALID_PAYMENT_TYPES = (0, 1, 2, 3, 4, 5, 6)

# Payment type code -> name; anything else (null included) is "Other".
PAYMENT_TYPE_NAMES = {
    0: "Flex Fare trip",
    1: "Credit card",
    2: "Cash",
    3: "No charge",
    4: "Dispute",
    5: "Unknown",
    6: "Voided trip",
}
PAYMENT_TYPE_OTHER = "Other"

# Unit conversion and outlier bounds (speed strict, distance inclusive).
MILES_TO_KM = 1.60934
SPEED_MIN_KPH, SPEED_MAX_KPH = 5, 120
DISTANCE_MAX_KM = 160

# Text formats.
HOUR_LABEL_FORMAT = "%02d:00"
WEEKDAY_NAME_PATTERN = "EEEE"
MONTH_LABEL_PATTERN = "MM/yyyy"
ISO_SECONDS_PATTERN = "yyyy-MM-dd'T'HH:mm:ss"
MESSAGE_TIME_PATTERN = "yyyy-MM-dd HH:mm:ss"

# Messages: topic per taxi type, key default for an absent pickup location.
TOPIC_PATTERN = "{taxi_type}_trip_data"
DEFAULT_MESSAGE_KEY = "default"

# Replay pacing: wait min(gap / speed, cap) seconds between records.
REPLAY_SPEED = 2.0
REPLAY_CAP_SECONDS = 10.0

# Paging bounds.
PAGE_LIMIT_MIN, PAGE_LIMIT_MAX = 1, 100000
PAGE_LIMIT_DEFAULT = 100

# Top-k size of the route finders and size of the merged popular list.
TOP_ROUTES_K = 5
POPULAR_ROUTES_SHOWN = 10

# Live chart: window of +-1 hour around the latest actual point, 5-minute ticks.
TIMELINE_HALF_WINDOW_MINUTES = 60
TIMELINE_TICK_MINUTES = 5

# Running-total key expiry (idle seconds).
RUNNING_TOTAL_TTL_SECONDS = 86400
# ours: a greater amount is no fare and goes to quarantine, so sums stay within their decimals
AMOUNT_MAX = 1e12

# Forecast feature columns, in order.
FORECAST_FEATURES = ("hour", "day_of_week", "is_weekend", "trip_count")

# Idle stop: this many polls without input rows, one poll every N seconds.
IDLE_POLLS, IDLE_POLL_SECONDS = 5, 10

# ---------------------------------------------------------------------------
# END FIXED VALUES
# ---------------------------------------------------------------------------

ZONE_SCHEMA = StructType(
    [
        StructField("LocationID", IntegerType(), True),
        StructField("Borough", StringType(), True),
        StructField("Zone", StringType(), True),
        StructField("service_zone", StringType(), True),
    ]
)

MESSAGE_SCHEMA = StructType(
    [
        StructField("timestamp", StringType(), True),
        StructField("trip_count", LongType(), True),
        StructField("predicted_timestamp", StringType(), True),
        StructField("predicted_trip_count", LongType(), True),
    ]
)

PARTITION_COLUMNS = ("year", "month", "day", "hour")
TIME_KEYS = ("year", "month")
ROUTE_KEYS = ("year", "month", "pickup_zone", "dropoff_zone")

TRIP_COLUMNS = tuple(f.name for f in TRIP_SCHEMA.fields)
