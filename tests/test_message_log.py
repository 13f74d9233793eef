"""Messages by partition and offset: starting offsets, rate, lost data, commits."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cabline.streaming import ingest as SI
from cabline.streaming import message_log as ML


def _append(spark, log, a, b, **kw):
    ML.append_messages(spark.range(a, b, 1, 3).select((F.col("id") % 5).cast("string").alias("key"), F.col("id").cast("string").alias("value")), log, partitions=4, **kw)


def _read(spark, base, name, limit=None, **kw):
    """What a query of that name reads now, by micro-batch; run again it goes on."""
    src = SI.StreamSource(format="log", path=f"{base}/log", position=f"{base}/{name}/position", max_offsets_per_trigger=limit, **kw)
    got = []
    q = SI.start_foreach_batch(SI.read_trip_stream(spark, src), lambda df, i: got.append(sorted(int(r.value) for r in df.collect())),
                               f"{base}/{name}/ck", trigger="0 seconds", available_now=not limit)
    if limit:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()
    return [b for b in got if b]


def test_starting_offsets_and_rate(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    _append(spark, log, 0, 20)
    ends = ML.Log(log).newest()["ends"]
    assert sum(ends) == 20 and len(ends) == 4
    assert _read(spark, tmp_dir, "latest") == []
    _append(spark, log, 20, 30)
    later = list(range(20, 30))
    assert _read(spark, tmp_dir, "latest") == [later]  # began at the end of what was there at its first start
    assert _read(spark, tmp_dir, "given", starting_offsets=json.dumps({str(p): x for p, x in enumerate(ends)})) == [later]
    assert _read(spark, tmp_dir, "mixed", starting_offsets=json.dumps({str(p): -2 for p in range(4)})) == [list(range(30))]
    batches = _read(spark, tmp_dir, "slow", limit=7, starting_offsets="earliest")
    assert sorted(sum(batches, [])) == list(range(30)) and len(batches) >= 5 and max(map(len, batches)) <= 7
    _append(spark, log, 30, 40)
    batches = _read(spark, tmp_dir, "slow", limit=7, starting_offsets="earliest")  # goes on, nothing twice
    assert sorted(sum(batches, [])) == list(range(30, 40)) and max(map(len, batches)) <= 7
    rows = ML.read_messages(spark, log).groupBy("partition").agg(F.count("*").alias("n"), F.max("offset").alias("m"), F.countDistinct("offset").alias("d"), F.countDistinct("key")).collect()
    assert all(r.n == r.d == r.m + 1 for r in rows)


def test_lost_data_fails_or_is_left_out(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    _append(spark, log, 0, 20)
    _append(spark, log, 20, 30)
    gone = ML.Log(log).commit_at(0)["segments"][0]
    lost = {int(r.value) for r in ML.read_messages(spark, log).where((F.col("partition") == gone[0]) & F.col("offset").between(gone[1], gone[2] - 1)).collect()}
    os.remove(f"{log}/segments/{gone[3]}")
    assert lost and _read(spark, tmp_dir, "tolerant", starting_offsets="earliest") == [sorted(set(range(30)) - lost)]
    with pytest.raises(Exception, match="are gone"):
        _read(spark, tmp_dir, "strict", starting_offsets="earliest", fail_on_data_loss=True)
    ends = ML.Log(log).commit_at(0)["ends"]
    ML.Log(log).trim(dict(enumerate(ends)))
    zero = json.dumps({str(p): 0 for p in range(4)})
    assert _read(spark, tmp_dir, "trimmed", starting_offsets=zero) == [list(range(20, 30))]
    with pytest.raises(Exception, match="are gone"):
        _read(spark, tmp_dir, "trimmed_strict", starting_offsets=zero, fail_on_data_loss=True)


def test_repeated_and_aborted_epochs(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    for _ in range(2):
        _append(spark, log, 0, 10, writer="w", epoch=0)
    assert ML.read_messages(spark, log).count() == 10 and len(os.listdir(f"{log}/segments")) == sum(map(len, [ML.Log(log).newest()["segments"]]))
    bad = spark.range(0, 20, 1, 4).select(F.lit("k").alias("key"), F.when(F.col("id") == 19, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("string").alias("value"))
    with pytest.raises(Exception):
        ML.append_messages(bad, log, partitions=4)
    assert ML.read_messages(spark, log).count() == 10
    # a stream whose last batch is replayed, as after a driver lost between the commit and the checkpoint's own
    src = SI.StreamSource(format="log", path=log, position=f"{tmp_dir}/position", starting_offsets="earliest")
    for _ in range(2):
        q = SI.start_message_sink(SI.read_trip_stream(spark, src), f"{tmp_dir}/copy", f"{tmp_dir}/ck", "relay", 4, available_now=True)
        q.awaitTermination()
        assert sorted(int(r.value) for r in ML.read_messages(spark, f"{tmp_dir}/copy").collect()) == list(range(10))
        for f in os.listdir(f"{tmp_dir}/ck/commits"):
            os.remove(f"{tmp_dir}/ck/commits/{f}")


def test_empty_log_and_null_keys(spark, tmp_dir):
    assert ML.read_messages(spark, f"{tmp_dir}/none").count() == 0
    ML.append_messages(spark.createDataFrame([(None, "a"), ("", None)], "key string, value string"), f"{tmp_dir}/log")
    assert sorted((r.key or "-", r.value or "-") for r in ML.read_messages(spark, f"{tmp_dir}/log").collect()) == [("-", "-"), ("-", "a")]
