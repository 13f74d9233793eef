import datetime as dt

from pyspark.sql import functions as F

from cabline.functions.timeparts import serving_features_reference, time_features
from cabline.operators import forecast as FC


def _series(spark, hours=200):
    base = dt.datetime(2024, 1, 1)
    rows = [(base + dt.timedelta(hours=h),) for h in range(hours) for _ in range(1 + h % 5) if h % 17 != 3]
    return spark.createDataFrame(rows, "tpep_pickup_datetime timestamp")


def test_weekday_codings(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 7, 9),), (dt.datetime(2024, 1, 8, 9),)], "t timestamp")
    shared = [tuple(r) for r in df.select(*time_features("t").values()).collect()]
    upstream = [tuple(r) for r in df.select(*serving_features_reference("t").values()).collect()]
    assert shared == [(9, 1, 1), (9, 2, 0)]  # Sunday = 1 on both sides
    assert upstream == [(9, 7, 1), (9, 1, 0)]  # serving side of the upstream job: Monday = 1


def test_labels_skip_and_grid(spark):
    s = FC.hourly_series(_series(spark))
    skip = {r["pickup_hour"]: r["future_trip_count"] for r in FC.add_label(s, "skip").collect()}
    grid = {r["pickup_hour"]: r["future_trip_count"] for r in FC.add_label(s, "grid").collect()}
    h2 = dt.datetime(2024, 1, 1, 2)
    assert skip[h2] == 5  # hour 3 is empty: the next present hour (4) has 5 trips
    assert h2 not in grid  # no true neighbour
    assert len(skip) == s.count() - 1 and len(grid) < len(skip)


def test_fit_and_score_next_hour(spark):
    train = FC.add_label(FC.hourly_series(_series(spark)), "grid")
    model = FC.fit_forecast(train, num_trees=5, max_depth=3)
    stats = spark.createDataFrame(
        [(dt.datetime(2024, 1, 3, 10, 59, 30), 4, 120)],
        "max_pickup_time timestamp, hour_trip_count long, trip_count_total long",
    )
    msg = FC.score_next_hour(model, FC.serving_features(stats)).first()
    assert msg["timestamp"] == "2024-01-03 10:59:30" and msg["predicted_timestamp"] == "2024-01-03 11:59:30"
    assert msg["trip_count"] == 120 and msg["predicted_trip_count"] >= 120
    _ = F
