"""Nothing is lost or changed without a word: unreadable state and tables, empty
re-runs, other message forms, time zones, nulls, paging past the end."""

import datetime as dt
import os
import subprocess
import sys
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cabline import session
from cabline.operators import serving as S
from cabline.operators import timeline as TL
from cabline.operators.ordered import next_value, previous_value, running_sum
from cabline.operators.replay import decode_messages, replay_schedule, to_messages
from cabline.plans import registry
from cabline.plans.ingest import split
from cabline.sinks import tables as K
from cabline.sinks.messages import MessageTarget, write_messages
from cabline.sources import bindings as B
from cabline.streaming import ingest as SI
from cabline.streaming import live as SL
from tests.conftest import ROOT, SF_SMALL
from tests.fixtures import frame


def _spoil(folder):
    """Make every Parquet file below ``folder`` unreadable."""
    for d, _, names in os.walk(folder):
        for n in names:
            if n.endswith(".parquet"):
                with open(os.path.join(d, n), "wb") as f:
                    f.write(b"not parquet")
            elif n.endswith(".crc"):
                os.remove(os.path.join(d, n))


def test_unreadable_state_fails(spark, tmp_dir):
    trips = split(B.trips(spark, SF_SMALL))[0]
    sink = SL.LiveSink(f"{tmp_dir}/state", f"{tmp_dir}/msg")
    sink(trips.limit(10), 0)
    _spoil(f"{tmp_dir}/state")
    with pytest.raises(Exception, match="(?i)parquet"):
        sink(trips.limit(5), 1)


def test_state_of_another_checkpoint_fails(spark, tmp_dir):
    trips = split(B.trips(spark, SF_SMALL))[0]
    sink = SL.LiveSink(f"{tmp_dir}/state", f"{tmp_dir}/msg")
    sink(trips.limit(0), 0)  # nothing so far: no state, no message
    assert session.child_names(spark, f"{tmp_dir}/state") in ([], ["_SUCCESS"])
    for k in range(1, 6):
        sink(trips.limit(3), k)
    assert SL._batch_ids(spark, f"{tmp_dir}/state") == [3, 4, 5]
    assert spark.read.parquet(f"{tmp_dir}/state").agg(F.max("total")).first()[0] == 15
    with pytest.raises(ValueError, match="another checkpoint"):
        sink(trips.limit(3), 0)


def test_unreadable_table_is_not_replaced(spark, tmp_dir):
    old, new = spark.range(5).withColumn("v", F.lit(1)), spark.range(3, 8).withColumn("v", F.lit(2))
    first = K.merge_by_key(spark, old, f"{tmp_dir}/none", ["id"], f"{tmp_dir}/v1")
    assert first.count() == 5
    assert K.merge_by_key(spark, new, f"{tmp_dir}/v1", ["id"], f"{tmp_dir}/v2").count() == 8
    _spoil(f"{tmp_dir}/v1")
    with pytest.raises(Exception, match="(?i)parquet"):
        K.merge_by_key(spark, new, f"{tmp_dir}/v1", ["id"], f"{tmp_dir}/v3")


def test_rerun_without_rows_empties_the_month(spark, tmp_dir):
    rows = spark.createDataFrame([(2024, 1, 5), (2024, 2, 6)], "year int, month int, v int")
    K.replace_partitions(rows, f"{tmp_dir}/t")
    K.replace_partitions(rows.where("false"), f"{tmp_dir}/t", requested={"year": 2024, "month": 1})
    K.replace_partitions(rows.where("false"), f"{tmp_dir}/t", requested={"year": 2024, "month": 9})
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_dir}/t").select("year", "month", "v").collect()] == [(2024, 2, 6)]
    K.replace_partitions(rows.where("month = 1"), f"{tmp_dir}/t", requested={"year": 2024, "month": 1})
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 2


def test_json_feed_equals_text_feed(spark, tmp_dir):
    msgs = to_messages(frame(spark).drop("case"))
    got = {}
    for form in ("json", "text"):
        write_messages(msgs, MessageTarget(format=form, path=f"{tmp_dir}/{form}"))
        src = SI.StreamSource(format=form, path=f"{tmp_dir}/{form}", max_bytes_per_trigger=64 << 20)
        valid, _ = SI.split_stream(SI.parse_stream(SI.read_trip_stream(spark, src)))
        SI.start_parquet_sink(valid, f"{tmp_dir}/v-{form}", f"{tmp_dir}/c-{form}", ("year",), available_now=True).awaitTermination()
        got[form] = sorted(map(str, spark.read.parquet(f"{tmp_dir}/v-{form}").collect()))
    assert got["json"] == got["text"] and got["json"]
    with pytest.raises(ValueError, match="unknown source format"):
        SI.read_trip_stream(spark, SI.StreamSource(format="csv", path=tmp_dir))


def test_late_rows_go_to_their_own_hour(spark, tmp_dir):
    """A record that arrives hours after later ones is appended to its hour's folder; nothing is dropped."""
    early, late = (frame(spark).drop("case").where("tpep_pickup_datetime is not null") for _ in range(2))
    early = early.withColumn("tpep_pickup_datetime", F.expr("tpep_pickup_datetime + interval 2 days"))
    early = early.withColumn("tpep_dropoff_datetime", F.expr("tpep_dropoff_datetime + interval 2 days"))
    for part in (early, late):
        write_messages(to_messages(part), MessageTarget(format="text", path=f"{tmp_dir}/topic/{len(os.listdir(tmp_dir))}"))
        src = SI.StreamSource(format="text", path=f"{tmp_dir}/topic/*")
        for q in SI.start_storage(SI.parse_stream(SI.read_trip_stream(spark, src)), f"{tmp_dir}/v", f"{tmp_dir}/e", f"{tmp_dir}/c", available_now=True):
            q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/v")
    want = split(early)[0].unionByName(split(late)[0])
    assert got.count() == want.count() > 0
    assert got.groupBy("year", "month", "day", "hour").count().exceptAll(want.groupBy("year", "month", "day", "hour").count()).count() == 0


def test_decode_takes_fractions_and_blanks(spark):
    texts = ["2024-01-01T10:00:00", "2024-01-01T10:00:00.500", "2024-01-01 10:00:00", "nonsense"]
    rows = spark.createDataFrame([(f'{{"VendorID":1,"tpep_pickup_datetime":"{t}"}}',) for t in texts], "value string")
    got = [r[0] and r[0].isoformat() for r in decode_messages(rows, keep_raw=False).select("tpep_pickup_datetime").collect()]
    assert got == ["2024-01-01T10:00:00", "2024-01-01T10:00:00.500000", "2024-01-01T10:00:00", None]


_ZONE_PROBE = """
import sys; sys.path.insert(0, {root!r})
import datetime as dt
from cabline.session import get_session
s = get_session("local[2]", shuffle_partitions=2, extra={{"spark.ui.enabled": "false", "spark.checkpoint.dir": {tmp!r}}})
s.sparkContext.setLogLevel("OFF")
from cabline.operators.rules import calendar_filter
from cabline.streaming.live import LiveSink
t = s.sql("select cast(x as timestamp) tpep_pickup_datetime from values ('2024-01-01 00:00:00'), ('2024-01-31 23:30:00'),"
          " ('2024-01-31 23:10:00'), ('2024-02-01 00:00:00') v(x)")
jan = calendar_filter(t, "tpep_pickup_datetime", 2024, 1)
sink = LiveSink({tmp!r} + "/state", {tmp!r} + "/msg", now=lambda: dt.datetime(2024, 1, 1))
sink(jan, 0); sink(jan, 1)
st = s.read.parquet({tmp!r} + "/state").orderBy("batch_id")
print("OUT", jan.count(), [tuple(r) for r in st.selectExpr("total", "cast(hour as string)", "hour_count", "cast(updated_at as string)").collect()])
"""


def test_drivers_zone_plays_no_part(tmp_dir):
    out = {}
    for zone in ("UTC", "Asia/Kolkata"):
        code = _ZONE_PROBE.format(root=ROOT, tmp=f"{tmp_dir}/{zone[:3]}")
        run = subprocess.run([sys.executable, "-c", code], env=os.environ | {"TZ": zone}, capture_output=True, text=True, timeout=300)
        out[zone] = next((x for x in run.stdout.splitlines() if x.startswith("OUT")), run.stderr[-2000:])
    want = "OUT 3 [(3, '2024-01-31 23:00:00', 2, '2024-01-01 00:00:00'), (6, '2024-01-31 23:00:00', 4, '2024-01-01 00:00:00')]"
    assert out == {"UTC": want, "Asia/Kolkata": want}


def _with_nulls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(60):
        ts = None if i % 11 == 0 else t0 + dt.timedelta(hours=7 * (i % 17))
        rows.append((i, [None, "a", "b"][i % 3], ts, None if i % 5 == 0 else i))
    return spark.createDataFrame(rows, "id long, g string, ts timestamp, v long")


@pytest.mark.parametrize("hot", [None, 2])
def test_ordered_operators_with_nulls(spark, hot):
    df = _with_nulls(spark)
    w = Window.partitionBy("g").orderBy("ts", "id")
    for fn, want in (
        (previous_value, F.lag("v").over(w)),
        (next_value, F.lead("v").over(w)),
        (running_sum, F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    ):
        a = {r["id"]: r["x"] for r in df.withColumn("x", want).collect()}
        b = {r["id"]: r["x"] for r in fn(df, "ts", "v", "x", "g", "id", bucket_unit="day", hot_rows=hot).collect()}
        assert a == b, fn.__name__


def test_replay_schedule_with_null_unit(spark):
    got = replay_schedule(_with_nulls(spark).where("ts is not null"), "ts", ("g",), ["id"]).where("g is null").orderBy("ts", "id").collect()
    assert got[0].send_offset_seconds == 0 and None not in [r.send_offset_seconds for r in got]
    assert [r.send_offset_seconds for r in got] == sorted(r.send_offset_seconds for r in got)


def test_bad_message_time_is_quarantined(spark):
    rows = [(1, "2024-01-01 10:00:00", 5, "2024-01-01 11:00:00", 7), (2, "10 o'clock", 6, "2024-01-01 12:00:00", 8)]
    feed = spark.createDataFrame(rows, "seq long, timestamp string, trip_count long, predicted_timestamp string, predicted_trip_count long")
    assert TL.merge_timeline(feed).count() == 3
    assert [r.seq for r in TL.bad_messages(feed).collect()] == [2]
    assert TL.last_actual(feed).first().trip_count == 5
    assert TL.last_actual(feed.where("seq = 2")).collect() == []


def test_page_contract(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (3, 1), (3, None), (4, 1)], "a long, b long")
    env = lambda o, n: tuple(S.page_envelope(df, o, n).first())
    assert env(0, 2) == ("ok", 5, 0, 2) and env(5, 2) == ("done", 5, 5, 2) and env(100, 2) == ("done", 5, 100, 2)
    with pytest.raises(ValueError):
        S.page_envelope(df, -1)
    seen, last = [], None
    while rows := S.page_after(df, ["a", "b"], last, 2).collect():
        seen += [tuple(r) for r in rows]
        last = rows[-1].asDict()
    assert seen == [(None, 1), (None, 2), (3, None), (3, 1), (4, 1)]


def test_serving_reads_pruned_partitions(spark):
    plan = lambda q: registry.QUERIES[q](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    for q in ("time_by_month", "time_range", "time_year_range", "routes_by_month", "top_pickups", "top_dropoffs", "top_routes_zone", "popular_routes"):
        text = plan(q)
        assert "PartitionFilters: [isnotnull(year" in text, q
        assert "l_orderkey" not in text, q
    for q in ("time_all_desc", "routes_by_zone", "top_routes_all", "dropoff_only_routes", "dropoff_only_antijoin", "chart_labels"):
        assert "l_orderkey" not in plan(q), q


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        _conf = {}

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_scratch_is_removed(spark, monkeypatch, tmp_dir):
    monkeypatch.setattr(session, "_SCRATCH", {})
    monkeypatch.setattr(session, "shared_dir", lambda s: tmp_dir)
    path = session.scratch_path(spark, "gone")
    assert path.startswith(f"{tmp_dir}/cabline-")
    spark.range(3).write.parquet(path)
    assert session.path_exists(spark, path)
    session.remove_scratch(spark)
    assert session.child_names(spark, tmp_dir) == [] and not session._SCRATCH


def test_scratch_is_removed_when_the_driver_ends(tmp_dir):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from cabline.session import get_session, scratch_path
s = get_session("local[1]", extra={{"spark.ui.enabled": "false", "spark.checkpoint.dir": {tmp_dir!r}}})
s.range(3).write.parquet(scratch_path(s, "x"))
s.range(3).write.parquet(scratch_path(s, "y"))
import os; print("OUT", sum(n.startswith("cabline-") for n in os.listdir({tmp_dir!r})))
"""
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "OUT 1" in run.stdout, run.stderr[-2000:]
    for _ in range(50):  # the JVM ends a little after the driver
        if not [n for n in os.listdir(tmp_dir) if n.startswith("cabline-")]:
            break
        time.sleep(0.2)
    assert not [n for n in os.listdir(tmp_dir) if n.startswith("cabline-")]


def test_jdbc_writes_carry_table_and_options(spark, monkeypatch):
    """The options of the three database writes; no database runs here."""
    from pyspark.sql import DataFrameWriter

    from cabline.plans.jobs import _table

    seen = []
    monkeypatch.setattr(DataFrameWriter, "jdbc", lambda self, **kw: seen.append(kw))
    db = {"url": "jdbc:x://h/db", "properties": {"user": "u"}}
    K.write_table(spark.range(1), jdbc=_table(db, "fact_trips"))
    K.replace_partitions(spark.range(1), jdbc=_table(db, "analyze_by_time"))
    assert [(s["table"], s["mode"], s["properties"]) for s in seen] == [
        ("fact_trips", "overwrite", {"batchsize": "50000", "user": "u"}),
        ("analyze_by_time", "append", {"batchsize": "50000", "user": "u"}),
    ]
