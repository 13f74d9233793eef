import datetime as dt

from cabline.operators import timeline as TL

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def _fmt(t):
    return t.strftime("%Y-%m-%d %H:%M:%S")


def _feed(spark):
    h = dt.timedelta(hours=1)
    rows = [
        # seq, timestamp, total, predicted_timestamp, predicted
        (1, T0, 10, T0 + h, 30),
        (2, T0 + dt.timedelta(minutes=30), 20, T0 + dt.timedelta(minutes=90), 35),
        (3, T0 + dt.timedelta(minutes=30), 25, T0 + dt.timedelta(minutes=90), 40),  # upsert: last wins
        (4, T0 + h, 33, T0 + 2 * h, 50),  # actual lands where a prediction was
    ]
    return spark.createDataFrame(
        [(s, _fmt(a), c, _fmt(p), pc) for s, a, c, p, pc in rows],
        "seq long, timestamp string, trip_count long, predicted_timestamp string, predicted_trip_count long",
    )


def test_merge_last_write_and_match(spark):
    t = {r["ts"]: (r["trip_count"], r["predicted_trip_count"]) for r in TL.merge_timeline(_feed(spark)).collect()}
    assert t[T0] == (10, None)
    assert t[T0 + dt.timedelta(minutes=30)] == (25, None)
    assert t[T0 + dt.timedelta(hours=1)] == (33, 30)
    assert t[T0 + dt.timedelta(minutes=90)] == (None, 40)
    assert t[T0 + dt.timedelta(hours=2)] == (None, 50)


def test_window_kind_bridge_and_grid(spark):
    merged = TL.merge_timeline(_feed(spark))
    w = TL.chart_window(merged)
    rows = w.collect()
    m = T0 + dt.timedelta(hours=1)
    assert [r["ts"] for r in rows] == sorted(r["ts"] for r in rows)
    # +-1 h around the latest actual point, both ends included
    assert {r["ts"] for r in rows} == {T0, T0 + dt.timedelta(minutes=30), m, T0 + dt.timedelta(minutes=90),
                                       T0 + dt.timedelta(hours=2)}
    kinds = {r["ts"]: r["point_kind"] for r in rows}
    assert kinds[m] == "actual" and kinds[T0 + dt.timedelta(hours=2)] == "predicted"
    b = {r["ts"]: r["predicted_trip_count"] for r in TL.bridge(w).collect()}
    assert b[m] == 33 and b[T0 + dt.timedelta(minutes=90)] == 40
    ticks = [r["tick"] for r in TL.time_grid(TL.latest_actual(merged)).collect()]
    assert len(ticks) == 24 and ticks[0] == m - dt.timedelta(hours=1)
    assert ticks[-1] == m + dt.timedelta(minutes=55)


def test_message_feed_running_total(spark):
    ev = spark.createDataFrame(
        [(T0 + dt.timedelta(minutes=m),) for m in (0, 1, 16, 17, 18, 50)], "ts timestamp"
    )
    f = sorted(TL.message_feed(ev, "ts").collect(), key=lambda r: r["seq"])
    assert [r["trip_count"] for r in f] == [2, 5, 6]
    assert f[0]["timestamp"] == _fmt(T0 + dt.timedelta(minutes=1))
    assert f[0]["predicted_timestamp"] == _fmt(T0 + dt.timedelta(minutes=61))
    assert f[1]["predicted_trip_count"] == 5 + 3 * 4
