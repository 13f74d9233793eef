"""Stores of many small files, compacted while they are read and appended to."""

from collections import Counter

from pyspark.sql import functions as F

from cabline.operators.replay import to_messages
from cabline.sinks import compaction as CO
from cabline.sources import bindings as B
from cabline.streaming import ingest as SI
from tests.conftest import SF_SMALL

COLS = ("year", "month")


def _append(spark, base, trips, name):
    to_messages(trips).select("value").repartition(3).write.text(f"{base}/topic/{name}")
    src = SI.StreamSource(format="text", path=f"{base}/topic/*", max_files_per_trigger=1)
    valid, _ = SI.split_stream(SI.parse_stream(SI.read_trip_stream(spark, src)))
    SI.start_parquet_sink(valid, f"{base}/store", f"{base}/ck", COLS, available_now=True).awaitTermination()


def _rows(df):
    return sorted(map(tuple, df.select(F.xxhash64(*df.columns), F.lit(1)).collect()))


def test_compaction_keeps_each_row_once(spark, tmp_dir):
    trips, store, out = B.trips(spark, SF_SMALL), f"{tmp_dir}/store", f"{tmp_dir}/compacted"
    _append(spark, tmp_dir, trips.where("payment_type <= 2"), "a")
    want = _rows(spark.read.parquet(store))
    before = CO.read_compacted(spark, store, out)
    assert _rows(before) == want  # nothing compacted yet
    assert CO.compact(spark, store, out, COLS) > 1
    assert _rows(before) == want  # a reader that planned before
    after = CO.read_compacted(spark, store, out)
    assert after.dtypes == spark.read.parquet(store).dtypes and _rows(after) == want
    assert set(Counter(CO._partition(f, COLS) for f in after.inputFiles()).values()) == {1}
    assert CO.compact(spark, store, out, COLS) == 0  # nothing new
    _append(spark, tmp_dir, trips.where("payment_type between 3 and 4"), "b")
    want = _rows(spark.read.parquet(store))
    both = CO.read_compacted(spark, store, out)
    assert _rows(both) == want and len(both.inputFiles()) > len(after.inputFiles())
    assert CO.compact(spark, store, out, COLS) > 1
    last = CO.read_compacted(spark, store, out)
    assert _rows(both) == _rows(last) == want
    assert set(Counter(CO._partition(f, COLS) for f in last.inputFiles()).values()) == {1}
    one = last.where("year = 1996 and month = 3")
    assert "PartitionFilters: [isnotnull(year" in one._jdf.queryExecution().executedPlan().toString()


def test_compaction_cut_off_before_its_manifest(spark, tmp_dir):
    store, out = f"{tmp_dir}/store", f"{tmp_dir}/compacted"
    _append(spark, tmp_dir, B.trips(spark, SF_SMALL).where("payment_type = 1"), "a")
    want = _rows(spark.read.parquet(store))
    spark.read.parquet(store).write.partitionBy(*COLS).parquet(f"{out}/data/version=1")  # files, no manifest
    assert _rows(CO.read_compacted(spark, store, out)) == want
    assert CO.compact(spark, store, out, COLS) > 0
    assert _rows(CO.read_compacted(spark, store, out)) == want
