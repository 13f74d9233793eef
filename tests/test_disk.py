"""What the streams over messages keep on disk: messages packed, stores gone after their last use."""

import glob
import os
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cabline.plans import registry
from cabline.sinks import tables as K
from cabline.streaming import keyed as KS
from cabline.streaming import message_log as ML
from tests.test_row_cost import own  # noqa: F401


@pytest.fixture
def scratch(own, tmp_dir, monkeypatch):  # noqa: F811
    """Own trips, and scratch folders by name."""
    monkeypatch.setattr(registry, "scratch_path", lambda _, name: f"{tmp_dir}/{name}")
    return tmp_dir


def _codecs(path):
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    return {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups}


def test_hourly_topic_is_packed_and_the_trips_go(spark, scratch):
    hours = registry.q_stream_hourly_counts(spark, scratch).collect()
    topic = f"{scratch}/hourly/topic"
    assert sorted(os.listdir(topic)) == ["0", "1", "2"]
    files = glob.glob(f"{topic}/*/part-*")
    assert files and all(f.endswith(".txt.gz") for f in files)
    assert spark.read.text(f"{topic}/*").count() == registry.B.trips().count()
    assert not os.path.exists(f"{scratch}/hourly/trips")
    assert hours == registry.HS.read_hours(spark, f"{scratch}/hourly/hours").collect()


def test_log_and_trips_go_after_their_last_use(spark, scratch):
    rows = {r.start: r.n for r in registry.q_stream_log_offsets(spark, scratch).groupBy("start").agg(F.count("*").alias("n")).collect()}
    trips = registry.B.trips()
    later = trips.where(registry._LATER).count()
    assert later and rows == {"all": trips.count(), "latest": later, "given": later, "lost": later}
    assert not os.path.exists(f"{scratch}/log/trips") and not os.path.exists(f"{scratch}/log/log")
    assert all(_codecs(f"{scratch}/log/{n}/out") == {"ZSTD"} for n in rows)


@pytest.mark.parametrize("held, least, most", [(ML.HELD_BYTES, 1, 1), (2000, 2, 6)])
def test_messages_of_many_batches_share_row_groups(tmp_dir, monkeypatch, held, least, most):
    monkeypatch.setattr(ML, "HELD_BYTES", held)
    batch = lambda k: pa.RecordBatch.from_pydict({"key": [None, "x"] * 20, "value": [f"{k} {i}" for i in range(40)], "partition": pa.array([0, 1] * 20, pa.int32())})
    segments = ML.stage(ML._Options({"path": f"{tmp_dir}/log"}), map(batch, range(12))).segments
    assert [(p, n) for p, n, _ in segments] == [(0, 240), (1, 240)]
    for p, _, name in segments:
        f = pq.ParquetFile(f"{tmp_dir}/log/segments/{name}")
        assert least <= f.num_row_groups <= most
        assert f.read().to_pylist() == [{"key": [None, "x"][p], "value": f"{k} {i}"} for k in range(12) for i in range(p, 40, 2)]


def test_stores_of_state_are_not_allocated_ahead(spark):
    key = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"
    before = spark.conf.get(key, None)
    with KS.state_settings(spark):
        assert spark.conf.get(key) == "false"
    assert spark.conf.get(key, None) == before


def test_written_table_is_packed_without_its_shuffles(spark, tmp_dir):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (blocks.getAllFiles().apply(i).getName() for i in range(blocks.getAllFiles().size())) if f.startswith("shuffle_")}
    before = shuffles()
    t = K.write_and_read(spark.range(1000).repartition(4, "id"), f"{tmp_dir}/t")
    until = time.time() + 20
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before
    assert t.count() == 1000 and _codecs(f"{tmp_dir}/t") == {"ZSTD"}
