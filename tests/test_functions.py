import datetime as dt

from pyspark.sql import functions as F

from cabline.functions.cleaning import decode_code, null_non_finite, parse_ts, payment_type_name
from cabline.functions.measures import duration_minutes, miles_to_km, round_half_up, speed_kph
from cabline.functions.timeparts import hour_label, month_label_from_parts, time_features, weekday_name
from cabline.operators.replay import decode_messages, to_messages
from cabline.plans.batch import derive_measures
from cabline.schema import TRIP_COLUMNS
from cabline.sources.trips import standardize
from tests.fixtures import frame


def test_round_half_up(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.005,), (0.125,)], "x double")
    got = [r[0] for r in df.select(round_half_up("x")).collect()]
    assert got == [1.01, 2.68, -1.01, 0.13]


def test_measures(spark):
    p = dt.datetime(2023, 1, 1, 10, 0, 0)
    df = spark.createDataFrame(
        [(p, p + dt.timedelta(minutes=30), 10.0), (p, p, 3.0), (p, p + dt.timedelta(seconds=61), 1.0)],
        "a timestamp, b timestamp, d double",
    )
    out = df.select(
        miles_to_km("d").alias("km"), duration_minutes("a", "b").alias("mins")
    ).withColumn("kph", speed_kph("km", "mins")).collect()
    assert (out[0]["km"], out[0]["mins"], out[0]["kph"]) == (16.09, 30.0, 32.18)
    assert out[1]["mins"] == 0.0 and out[1]["kph"] is None  # zero duration: null, no error
    assert out[2]["mins"] == 1.02 and out[2]["kph"] == round(1.61 / (1.02 / 60), 2)


def test_labels(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 7, 0), 7, 2024, 3)], "t timestamp, h int, y int, m int")
    r = df.select(
        hour_label("h"), weekday_name("t"), month_label_from_parts("y", "m"), *time_features("t").values()
    ).first()
    assert tuple(r) == ("07:00", "Saturday", "03/2024", 7, 7, 1)


def test_payment_names(spark):
    df = spark.createDataFrame([(0,), (6,), (7,), (None,)], "p int")
    got = [r[0] for r in df.select(payment_type_name("p")).collect()]
    assert got == ["Flex Fare trip", "Voided trip", "Other", "Other"]
    assert df.select(decode_code("p", {}, "x")).first()[0] == "x"


def test_null_non_finite(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (float("-inf"), 3), (1.5, 4)], "x double, i int")
    assert [r[0] for r in null_non_finite(df).orderBy("i").collect()] == [None, None, None, 1.5]


def test_standardize(spark):
    df = spark.createDataFrame(
        [("2023-01-01 10:00:00", "2023-01-01 10:10:00", "abc", "1.25", "x")],
        "lpep_pickup_datetime string, lpep_dropoff_datetime string, passenger_count string, Airport_fee string, extra_col string",
    )
    out = standardize(df)
    assert out.columns == list(TRIP_COLUMNS)
    r = out.first()
    assert r["tpep_pickup_datetime"] == dt.datetime(2023, 1, 1, 10, 0)
    assert r["passenger_count"] is None  # bad cell only
    assert r["airport_fee"] == 1.25
    assert r["VendorID"] is None
    assert "extra_col" in standardize(df, keep_extra=True).columns


def test_parse_ts_drops_unparseable(spark):
    df = spark.createDataFrame([("2023-01-01T10:00:00",), ("junk",), (None,)], "t string")
    out = parse_ts(df, "t").collect()
    assert [r[0] for r in out] == [dt.datetime(2023, 1, 1, 10, 0)]


def test_messages_round_trip_and_malformed(spark):
    trips = frame(spark).drop("case")
    msgs = to_messages(trips)
    assert msgs.filter(F.col("key") == "10").count() == trips.filter("PULocationID = 10").count()
    assert msgs.filter(F.col("key") == "default").count() == trips.filter("PULocationID IS NULL").count()
    back = decode_messages(msgs, keep_raw=False).select(*TRIP_COLUMNS)
    assert back.exceptAll(trips).count() == 0 and trips.exceptAll(back).count() == 0
    bad = spark.createDataFrame([("{not json",), (None,), ('{"VendorID": 1.5}',)], "value string")
    d = decode_messages(bad).collect()
    assert all(r["VendorID"] is None and r["tpep_pickup_datetime"] is None for r in d)
    assert d[0]["_raw"] == "{not json"


def test_derive_measures_columns(spark):
    from cabline.plans.ingest import split

    valid, _ = split(frame(spark).drop("case"))
    out = derive_measures(valid)
    for c in ("hour_label", "payment_type_name", "trip_distance_km", "trip_duration_minutes",
              "trip_speed_kph", "day_of_week", "month_label", "year", "month", "day", "hour"):
        assert c in out.columns
    r = out.first()
    assert r["trip_distance_km"] == 8.05 and r["trip_duration_minutes"] == 30.0 and r["trip_speed_kph"] == 16.1


def test_rounding_rule_at_any_magnitude(spark):
    """Half up on the value fixed to 8 decimals, exact half-cent ties and
    values far beyond 1e10 included; beyond 1e30 nothing is left to round."""
    import random
    from decimal import ROUND_HALF_UP, Decimal, getcontext

    getcontext().prec = 60

    def rule(v):
        if abs(v) >= 1e30:
            return v
        eight = Decimal(repr(v)).quantize(Decimal("1e-8"), ROUND_HALF_UP)
        return float(eight.quantize(Decimal("0.01"), ROUND_HALF_UP))

    rnd = random.Random(11)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(3000)] + [rnd.uniform(-1, 1) for _ in range(1000)]
    vals += [k / 1000 + 0.005 for k in range(-2000, 2000, 7)] + [0.0, -0.0, 1.005, 2.675, -2.675]
    vals += [2e11 + 0.125, 1e10, -3.3e15, 1e29, 1e35, 1.5e300]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for r in df.select("x", round_half_up("x").alias("y")).collect():
        assert r.y == rule(r.x), r
    assert spark.range(1).select(round_half_up(F.lit(None).cast("double"))).first()[0] is None
    assert df.filter(round_half_up("x") == 0).select(F.sum(F.signum(round_half_up("x")))).first()[0] in (0, None)
