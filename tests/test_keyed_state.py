"""State in Spark's own state store: the running total with expiry and the timeline by timestamp."""

from pyspark.sql import functions as F

from cabline.operators.timeline import merge_timeline
from cabline.operators.replay import to_messages
from cabline.plans.ingest import split
from cabline.sources import bindings as B
from cabline.streaming import ingest as SI
from cabline.streaming import keyed as KS
from tests.conftest import SF_SMALL


def _topic(df, path, files):
    to_messages(df).repartition(files, "key").select("value").write.mode("overwrite").text(path)


def _run(spark, base, arrival):
    src = SI.StreamSource(format="text", path=f"{base}/topic/*", max_files_per_trigger=1)
    valid, _ = SI.split_stream(SI.parse_stream(SI.read_trip_stream(spark, src)))
    with KS.state_settings(spark):
        q = SI.start_foreach_batch(KS.running_totals(valid, arrival=arrival), KS.ChangeLog(f"{base}/log"), f"{base}/ck", available_now=True, output_mode="complete")
    q.awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    last = log.agg(F.max("batch_id")).first()[0]
    return last + 1, sorted((r.first_arrival.hour, r.total) for r in log.where(F.col("batch_id") == last).collect()), KS.running_total(log.where(F.col("batch_id") == last)).first()


def test_running_total_survives_restart_and_expires(spark, tmp_dir):
    """Restarts with a clock of the test's: within a day the total goes on, after a day's pause it starts anew."""
    trips = B.trips(spark, SF_SMALL)
    parts = [trips.filter("payment_type < 3"), trips.filter("payment_type between 3 and 4"), trips.filter("payment_type = 5")]
    n = [split(p)[0].count() for p in parts]
    assert all(n)
    clock = lambda text: F.lit(text).cast("timestamp")
    _topic(parts[0], f"{tmp_dir}/topic/a", 3)
    batches, sessions, last = _run(spark, tmp_dir, clock("2024-01-01 10:00:00"))
    assert batches >= 3 and sessions == [(10, n[0])]
    _topic(parts[1], f"{tmp_dir}/topic/b", 1)
    _, sessions, last = _run(spark, tmp_dir, clock("2024-01-02 09:59:00"))
    assert sessions == [(10, n[0] + n[1])] and last.last_arrival.hour == 9
    _topic(parts[2], f"{tmp_dir}/topic/c", 1)
    _, sessions, last = _run(spark, tmp_dir, clock("2024-01-03 11:00:00"))
    assert sessions == [(10, n[0] + n[1]), (11, n[2])]
    assert last.total == n[2] and last.max_pickup_time == split(parts[2])[0].agg(F.max("tpep_pickup_datetime")).first()[0]


def test_running_total_by_wall_time(spark, tmp_dir):
    _topic(B.trips(spark, SF_SMALL), f"{tmp_dir}/topic/a", 2)
    batches, sessions, _ = _run(spark, tmp_dir, None)
    assert batches >= 2 and [x for _, x in sessions] == [split(B.trips(spark, SF_SMALL))[0].count()]


def test_timeline_emits_touched_points_only(spark, tmp_dir):
    schema = "seq long, timestamp string, trip_count long, predicted_timestamp string, predicted_trip_count long"
    t = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [
        [(1, t(0), 10, t(60), 50), (2, t(15), 20, t(75), 60)],
        [(3, t(60), 30, t(120), 70)],
        [(4, t(0), 11, "no time", 1), (0, t(15), 99, None, None)],  # a correction, and an older write that loses
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_dir}/topic/{k}")
        stream = spark.readStream.schema(schema).json(f"{tmp_dir}/topic/*")
        with KS.state_settings(spark):
            q = SI.start_foreach_batch(KS.timeline_changes(stream), KS.ChangeLog(f"{tmp_dir}/log"), f"{tmp_dir}/ck", available_now=True, output_mode="update")
        q.awaitTermination()
    log = spark.read.parquet(f"{tmp_dir}/log").withColumn("at", F.date_format("ts", "HH:mm"))
    changed = {k: sorted(r.at for r in log.where(F.col("batch_id") == k).collect()) for k in range(3)}
    assert changed == {0: ["00:00", "00:15", "01:00", "01:15"], 1: ["01:00", "02:00"], 2: ["00:00", "00:15"]}
    got = KS.read_log(spark, f"{tmp_dir}/log", "ts", KS.POINT_COLUMNS).select("ts", "trip_count", "predicted_trip_count")
    want = merge_timeline(spark.createDataFrame(sum(batches, []), schema)).select("ts", "trip_count", "predicted_trip_count")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
