"""Hand-made trip rows for the rule tests (one valid base row, then one row
per change)."""

import datetime as dt

from cabline.schema import TRIP_SCHEMA

BASE = {
    "VendorID": 1,
    "tpep_pickup_datetime": dt.datetime(2023, 1, 1, 10, 0, 0),
    "tpep_dropoff_datetime": dt.datetime(2023, 1, 1, 10, 30, 0),
    "passenger_count": 2,
    "trip_distance": 5.0,
    "RatecodeID": 1.0,
    "store_and_fwd_flag": "N",
    "PULocationID": 10,
    "DOLocationID": 20,
    "payment_type": 1,
    "fare_amount": 12.5,
    "extra": 0.5,
    "mta_tax": 0.5,
    "tip_amount": 2.0,
    "tolls_amount": 0.0,
    "improvement_surcharge": 0.3,
    "total_amount": 15.8,
    "congestion_surcharge": 2.5,
    "airport_fee": 0.0,
}

P = BASE["tpep_pickup_datetime"]

# (case name, changes, expected: "valid" | "error", reference behaviour)
CASES = [
    ("base", {}, "valid", "valid"),
    ("pickup_null", {"tpep_pickup_datetime": None}, "error", "error"),
    ("dropoff_null", {"tpep_dropoff_datetime": None}, "error", "error"),
    ("dropoff_eq_pickup", {"tpep_dropoff_datetime": P}, "error", "error"),
    ("dropoff_before_pickup", {"tpep_dropoff_datetime": P - dt.timedelta(minutes=1)}, "error", "error"),
    ("distance_zero", {"trip_distance": 0.0}, "error", "error"),
    ("distance_negative", {"trip_distance": -1.0}, "error", "error"),
    ("fare_negative", {"fare_amount": -0.01}, "error", "error"),
    ("total_negative", {"total_amount": -0.01}, "error", "error"),
    ("fare_zero", {"fare_amount": 0.0}, "valid", "valid"),
    ("total_zero", {"total_amount": 0.0}, "valid", "valid"),
    ("pu_0", {"PULocationID": 0}, "error", "error"),
    ("pu_264", {"PULocationID": 264}, "error", "error"),
    ("do_0", {"DOLocationID": 0}, "error", "error"),
    ("do_264", {"DOLocationID": 264}, "error", "error"),
    ("pu_1", {"PULocationID": 1}, "valid", "valid"),
    ("do_263", {"DOLocationID": 263}, "valid", "valid"),
    ("flag_x", {"store_and_fwd_flag": "X"}, "error", "error"),
    ("payment_7", {"payment_type": 7}, "error", "error"),
    ("passenger_null", {"passenger_count": None}, "valid", "valid"),
    ("ratecode_null", {"RatecodeID": None}, "valid", "valid"),
    ("flag_null", {"store_and_fwd_flag": None}, "valid", "valid"),
    ("airport_fee_null", {"airport_fee": None}, "valid", "valid"),
    ("congestion_null", {"congestion_surcharge": None}, "valid", "valid"),
    ("distance_null", {"trip_distance": None}, "error", "lost"),
    ("fare_null", {"fare_amount": None}, "error", "lost"),
    ("total_null", {"total_amount": None}, "error", "lost"),
    ("pu_null", {"PULocationID": None}, "error", "lost"),
    ("payment_null", {"payment_type": None}, "error", "lost"),
]


def rows():
    out = []
    for name, change, _, _ in CASES:
        r = dict(BASE)
        r.update(change)
        out.append(tuple(r[f.name] for f in TRIP_SCHEMA.fields) + (name,))
    return out


def frame(spark):
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType(TRIP_SCHEMA.fields + [StructField("case", StringType())])
    return spark.createDataFrame(rows(), schema)
