import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from cabline.operators.replay import to_messages
from cabline.plans.ingest import split
from cabline.schema import TRIP_COLUMNS
from cabline.sources import bindings as B
from cabline.streaming import control as C
from cabline.streaming import ingest as SI
from cabline.streaming import live as SL
from tests.conftest import SF_SMALL
from tests.fixtures import frame


def _publish(df, path, files=4):
    to_messages(df).repartition(files, "key").select("value").write.mode("overwrite").text(path)


def _stream(spark, path, per_trigger=1):
    src = SI.StreamSource(format="text", path=path, max_files_per_trigger=per_trigger)
    return SI.parse_stream(SI.read_trip_stream(spark, src))


def test_batch_equals_stream(spark, tmp_dir):
    trips = B.trips(spark, SF_SMALL)
    _publish(trips, f"{tmp_dir}/topic")
    qv, qe = SI.start_storage(_stream(spark, f"{tmp_dir}/topic"), f"{tmp_dir}/v", f"{tmp_dir}/e",
                              f"{tmp_dir}/ck", partition_cols=("year", "month"), available_now=True)
    qv.awaitTermination()
    qe.awaitTermination()
    bv, be = split(trips)
    cols = list(TRIP_COLUMNS) + ["year", "month", "day", "hour"]
    sv = spark.read.parquet(f"{tmp_dir}/v").select(*cols)
    se = spark.read.parquet(f"{tmp_dir}/e").select(*cols)
    assert sv.exceptAll(bv.select(*cols)).count() == 0 and bv.select(*cols).exceptAll(sv).count() == 0
    assert se.exceptAll(be.select(*cols)).count() == 0 and be.select(*cols).exceptAll(se).count() == 0
    assert spark.read.parquet(f"{tmp_dir}/e").filter(F.col("_raw").isNull()).count() == 0


def test_hourly_layout_and_null_pickup_partition(spark, tmp_dir):
    df = frame(spark).drop("case")
    _publish(df, f"{tmp_dir}/topic", files=1)
    qv, qe = SI.start_storage(_stream(spark, f"{tmp_dir}/topic"), f"{tmp_dir}/v", f"{tmp_dir}/e",
                              f"{tmp_dir}/ck", available_now=True)
    qv.awaitTermination()
    qe.awaitTermination()
    assert os.path.isdir(f"{tmp_dir}/v/year=2023/month=1/day=1/hour=10")
    assert os.path.isdir(f"{tmp_dir}/e/year=__HIVE_DEFAULT_PARTITION__")


def test_restart_does_not_double_count(spark, tmp_dir):
    trips = B.trips(spark, SF_SMALL)
    a, b = trips.filter("payment_type < 4"), trips.filter("payment_type >= 4")
    topic = f"{tmp_dir}/topic"
    _publish(a, f"{topic}/a", files=2)

    def run():
        valid, _ = SI.split_stream(_stream(spark, f"{topic}/*", per_trigger=1))
        q = SI.start_foreach_batch(valid, SL.LiveSink(f"{tmp_dir}/state", f"{tmp_dir}/msg"), f"{tmp_dir}/ck",
                                   available_now=True)
        q.awaitTermination()
        st = spark.read.parquet(f"{tmp_dir}/state")
        return st.orderBy(F.col("batch_id").desc()).first()["total"]

    assert run() == split(a)[0].count()
    assert run() == split(a)[0].count()  # restart, no new input: unchanged
    _publish(b, f"{topic}/b", files=2)
    assert run() == split(trips)[0].count()
    msgs = spark.read.parquet(f"{tmp_dir}/msg")
    assert msgs.agg(F.max("trip_count")).first()[0] == split(trips)[0].count()
    assert spark.read.parquet(f"{tmp_dir}/state").count() <= SL.KEPT_STATES
    assert msgs.filter(F.col("predicted_trip_count").isNotNull()).count() == 0  # no model given


def test_replayed_batch_is_idempotent_and_ttl(spark, tmp_dir):
    trips = split(B.trips(spark, SF_SMALL))[0]
    part1, part2 = trips.filter("payment_type < 3"), trips.filter("payment_type >= 3")
    clock = {"now": dt.datetime(2024, 1, 1, 0, 0)}
    sink = SL.LiveSink(f"{tmp_dir}/state", f"{tmp_dir}/msg", now=lambda: clock["now"])
    sink(part1, 0)
    sink(part2, 1)
    sink(part2, 1)  # replay of batch 1
    st = {r["batch_id"]: r["total"] for r in spark.read.parquet(f"{tmp_dir}/state").collect()}
    assert st == {0: part1.count(), 1: part1.count() + part2.count()}
    clock["now"] += dt.timedelta(hours=25)  # idle longer than the expiry
    sink(part1, 2)
    st = {r["batch_id"]: r["total"] for r in spark.read.parquet(f"{tmp_dir}/state").collect()}
    assert st[2] == part1.count()
    sink(part1.limit(0), 3)  # empty batch: state carried forward, no message
    st3 = spark.read.parquet(f"{tmp_dir}/state").filter("batch_id = 3").first()
    assert st3["total"] == part1.count() and st3["batch_trip_count"] == 0
    assert spark.read.parquet(f"{tmp_dir}/msg").filter("batch_id = 3").count() == 0
    sink(part2, 4)
    st4 = spark.read.parquet(f"{tmp_dir}/state").filter("batch_id = 4").first()
    assert st4["total"] == part1.count() + part2.count()


class FakeQuery:
    def __init__(self, rows):
        self.rows, self.isActive, self.stopped = list(rows), True, False

    @property
    def lastProgress(self):
        return {"numInputRows": self.rows.pop(0) if self.rows else 0}

    def stop(self):
        self.stopped, self.isActive = True, False


def test_stop_when_idle():
    q1, q2 = FakeQuery([5, 0, 0, 3] + [0] * 10), FakeQuery([0] * 20)
    n = C.stop_when_idle([q1, q2], polls=3, every=0, sleep=lambda s: None)
    assert q1.stopped and q2.stopped
    assert n == 7  # busy, idle, idle, busy (reset), idle x3


def test_running_total_builtin_state(spark, tmp_dir):
    trips = B.trips(spark, SF_SMALL)
    _publish(trips, f"{tmp_dir}/topic")
    valid, _ = SI.split_stream(_stream(spark, f"{tmp_dir}/topic"))
    name = "rt_" + uuid.uuid4().hex[:8]
    q = (SL.running_total_query_frame(valid).writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    totals = [r["total"] for r in spark.sql(f"SELECT total FROM {name}").collect()]
    assert max(totals) == split(trips)[0].count()
    assert sorted(totals) == totals or len(set(totals)) == len(totals)


def test_message_writer_file_forms(spark, tmp_dir):
    import pytest

    from cabline.sinks.messages import MessageTarget, write_messages

    msgs = to_messages(frame(spark).drop("case"))
    write_messages(msgs, MessageTarget(format="json", path=f"{tmp_dir}/j"))
    back = spark.read.json(f"{tmp_dir}/j")
    assert sorted(back.columns) == ["key", "value"] and back.count() == msgs.count()
    write_messages(msgs, MessageTarget(format="text", path=f"{tmp_dir}/t"))
    assert spark.read.text(f"{tmp_dir}/t").count() == msgs.count()
    with pytest.raises(ValueError):
        write_messages(msgs, MessageTarget(format="xml", path=f"{tmp_dir}/x"))


def test_stop_on_idle_by_events(spark, tmp_dir):
    """The query that goes idle first waits for the one that is still busy."""
    import time

    key = "spark.sql.streaming.noDataProgressEventInterval"
    before = spark.conf.get(key)
    spark.conf.set(key, "200ms")
    try:
        queries, seen = [], {"short": [], "long": []}
        for name, files in (("short", 1), ("long", 4)):
            spark.range(20 * files).repartition(files).write.json(f"{tmp_dir}/{name}")
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(f"{tmp_dir}/{name}")

            def take(df, i, name=name):
                time.sleep(1.5)
                seen[name].append(df.count())

            queries.append(SI.start_foreach_batch(stream, take, f"{tmp_dir}/ck-{name}", trigger="100 milliseconds", query_name=f"{name}_{uuid.uuid4().hex[:6]}"))
        watch = C.stop_on_idle(spark, queries, idles=3, timeout=60)
    finally:
        spark.conf.set(key, before)
    assert watch.done.is_set() and not any(q.isActive for q in queries)
    assert sum(seen["short"]) == 20 and sum(seen["long"]) == 80
    table = watch.table(spark)
    rows = {r.name.split("_")[0]: r.n for r in table.groupBy("name").agg(F.sum("input_rows").alias("n")).collect()}
    assert rows.get("long") == 80 and table.where("batch_id = 3 and seconds > 1").count() == 1
