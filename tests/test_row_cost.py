"""What a row costs: whole rows shuffled once, messages packed, measures and joins computed once."""

import datetime as dt
import glob
import re

import pytest
from pyspark.sql import functions as F

from cabline.functions.measures import round_half_up
from cabline.operators import mergeable as MG
from cabline.operators.replay import decode_messages, replay_schedule
from cabline.plans import batch, ingest, registry
from cabline.schema import ZONE_SCHEMA
from cabline.streaming.fanout import FanOut
from tests.fixtures import frame


@pytest.fixture
def own(spark, tmp_dir, monkeypatch):
    """The registry over own trips; the name of their folder stands in every plan that computes them."""
    path = f"{tmp_dir}/own_trips"
    frame(spark).drop("case").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k").write.parquet(path)
    trips, zones = spark.read.parquet(path), spark.createDataFrame([(10, "B", "Z", None), (20, "B", "Y", None)], ZONE_SCHEMA)
    monkeypatch.setattr(registry.B, "trips", lambda *_: trips)
    monkeypatch.setattr(registry.B, "table", lambda *_: trips)
    monkeypatch.setattr(registry.B, "zones", lambda *_: zones)
    return tmp_dir


def test_measures_computed_once(spark, own):
    """The bounds and the averages share one rounding per measure."""
    p = registry.processed(spark, own)
    plan = p.groupBy("year").agg(F.avg("trip_speed_kph"), F.avg("trip_distance_km"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("decimal(18,8)") == 3


def test_round_half_up_beside_ties(spark):
    """Values clear of a tie skip the decimals; both ways agree, signs and zeros included."""
    values = [k / 8 + d for k in range(-40, 41) for d in (0.0, 1e-9, -1e-9, 0.004999, 0.0049999999, -0.0050001)]
    values += [1e9 + 0.125, 1e18, 1e31, -0.001, 0.0, float("nan"), float("inf")]
    v = spark.createDataFrame([(x,) for x in values], "v double")
    long, wide = (F.round(F.col("v").try_cast(t), 2).cast("double") for t in ("decimal(18,8)", "decimal(38,8)"))
    got = v.select("v", F.coalesce(long, wide, "v").alias("a"), round_half_up("v").alias("b"))
    assert got.where("not (a <=> b) or cast(a as string) <> cast(b as string)").collect() == []


def test_topic_is_packed_where_it_is_made(spark, own):
    topic = registry.publish_messages(spark, own)
    files = glob.glob(f"{topic}/part-*")
    assert len(files) >= 2 * registry.BATCHES and all(f.endswith(".txt.gz") for f in files)
    assert spark.read.text(topic).count() == registry.B.trips().count()


def test_messages_parsed_once(spark):
    """Not once more for every rule on a column; what doesn't parse is a row of nulls."""
    raw = spark.createDataFrame([("garbage",), (None,), ('{"VendorID":1}',), ("",)], "value string")
    parsed = decode_messages(raw)
    valid, error = ingest.split(parsed)
    assert valid._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((str(r._raw), r.trip_distance, r.DOLocationID) for r in error.collect()) == sorted((str(r.value), None, None) for r in raw.collect())


def test_valid_rows_keep_no_raw_text(spark, tmp_dir):
    parsed = ingest.prepare(frame(spark).drop("case")).withColumn("_raw", F.lit("text"))
    FanOut(f"{tmp_dir}/stores")(parsed, 0)
    kept = {(r.store, r._raw) for r in spark.read.parquet(f"{tmp_dir}/stores/rows").select("store", "_raw").collect()}
    assert kept == {("valid", None), ("error", "text")}


def test_replay_shuffles_whole_rows_once(spark):
    start = dt.datetime(2023, 1, 31, 23, 0, 0)
    rows = [(start + dt.timedelta(seconds=7 * i) if i else None, i % 3, f"payload {i}") for i in range(900)]
    t = spark.createDataFrame(rows, "ts timestamp, n int, payload string").withColumns({"year": F.year("ts"), "month": F.month("ts")})
    out = replay_schedule(t, "ts", tiebreak=["n", "payload"], hot_rows=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    wide = [m for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", text) if "payload" in m]
    assert "Window" in plan and len(wide) == 1


def test_kinds_and_loads_read_stored_trips(spark, own, monkeypatch):
    """The four kinds and the five loads don't compute the trips again."""
    written, write = [], registry.K.write_partitioned
    monkeypatch.setattr(registry.K, "write_partitioned", lambda df, *a, **k: written.append(df.inputFiles()) or write(df, *a, **k))
    got = registry.q_drifting_months(spark, own)
    assert len(written) == 4 and not any("own_trips" in f for files in written for f in files)
    assert got.count() == registry.B.trips().where("tpep_pickup_datetime is not null").count()
    loads = []
    load = MG.write_load
    monkeypatch.setattr(MG, "write_load", lambda p, *a: loads.append(p.inputFiles()) or load(p, *a))
    monkeypatch.setattr(registry, "processed", lambda *_: batch.process(ingest.split(registry.B.trips())[0], registry.B.zones()))
    out = registry.q_monthly_incremental(spark, own).collect()
    assert len(loads) == 4 and not any("own_trips" in f for files in loads for f in files)
    assert sum(r.trip_count for r in out) == registry.processed().count()
