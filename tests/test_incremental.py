"""Pages by order statistics, mergeable aggregates, the fan-out sink and odd amounts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cabline.operators import mergeable as MG
from cabline.operators import paging as PG
from cabline.operators.analytics import monthly_analytics, route_analytics
from cabline.operators.replay import to_messages
from cabline.plans import batch
from cabline.plans.ingest import split
from cabline.schema import TRIP_COLUMNS
from cabline.sources import bindings as B
from cabline.streaming import fanout as FO
from cabline.streaming import ingest as SI
from cabline.streaming import live as SL
from tests.conftest import SF_SMALL
from tests.fixtures import frame

PARTS = list(TRIP_COLUMNS) + ["year", "month", "day", "hour"]


# ---- pages -----------------------------------------------------------------


@pytest.fixture(scope="module")
def numbers(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(r.choice([None, *range(40)]), k) for k in range(1000)]
    path = str(tmp_path_factory.mktemp("pages"))
    PG.write_page_index(spark.createDataFrame(rows, "a int, b int"), [F.col("a").asc_nulls_first(), "b"], path, partitions=8)
    return path, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


@pytest.mark.parametrize("offset, limit", [(0, 1), (0, 1000), (1, 100), (499, 3), (700, 250), (990, 100), (999, 5), (1000, 5), (10**9, 1)])
def test_pages(spark, numbers, offset, limit):
    path, want = numbers
    got = [(r.a, r.b, r.total) for r in PG.page_at(spark, path, offset, limit).collect()]
    assert got == [(*x, 1000) for x in want[offset : offset + limit]]


def test_deep_page_opens_few_partitions(spark, numbers):
    path, _ = numbers
    page = PG.page_at(spark, path, 700, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    opened = re.findall(r"\d+", re.sub(r"#\d+", "", scan))
    parts = {f.split("_part=")[1].split("/")[0] for f in spark.read.parquet(f"{path}/rows").inputFiles()}
    assert "_part" in scan and 1 <= len(set(opened)) <= 2 < len(parts) and set(opened) <= parts
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan


def test_pages_of_nothing(spark, tmp_dir):
    PG.write_page_index(spark.createDataFrame([], "a int, b int"), ["a"], tmp_dir)
    assert PG.page_at(spark, tmp_dir, 0, 10).collect() == []
    with pytest.raises(ValueError):
        PG.page_at(spark, tmp_dir, -1, 10)


# ---- mergeable aggregates ------------------------------------------------------


@pytest.fixture(scope="module")
def processed(spark):
    valid, _ = split(B.trips(spark, SF_SMALL))
    return batch.process(valid, B.zones(spark, SF_SMALL))


@pytest.mark.parametrize("table, whole", [(MG.MONTHLY, monthly_analytics), (MG.ROUTES, route_analytics)])
def test_loads_equal_the_whole(spark, tmp_dir, processed, table, whole):
    part = F.pmod(F.xxhash64("tpep_pickup_datetime"), F.lit(3))
    for k in range(3):
        MG.write_load(processed.where(part == k), tmp_dir, f"l{k}", table)
    MG.write_load(processed.where(part == 1), tmp_dir, "l1", table)  # again

    def rows(df):
        return sorted(map(str, df.collect()))

    want = whole(processed)
    read = lambda: MG.finished(MG.read_states(spark, tmp_dir, table), table).select(*want.columns)
    assert rows(read()) == rows(want)
    MG.compact(spark, tmp_dir, 1995, 6, "one", table)
    assert rows(read()) == rows(want)
    fewer = processed.where("payment_type < 3")
    MG.replace_month(fewer, tmp_dir, 1995, 6, "corrected", table)
    month = (F.col("year") == 1995) & (F.col("month") == 6)
    assert rows(read()) == rows(whole(processed.where(~month).unionByName(fewer.where(month))))
    MG.replace_month(processed.limit(0), tmp_dir, 1995, 6, "none", table)
    assert rows(read()) == rows(whole(processed.where(~month)))


def test_month_of_states_is_pruned(spark, tmp_dir, processed):
    MG.write_load(processed, tmp_dir, "all")
    plan = MG.read_states(spark, tmp_dir).where("year = 1995 and month = 6")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "1995" in plan.split("PartitionFilters", 1)[1].split("PushedFilters")[0]


# ---- fan-out ------------------------------------------------------------------


class Failing:
    """A live handler that fails the first time."""

    def __init__(self, then):
        self.then, self.failed = then, False

    def __call__(self, df, batch_id):
        if not self.failed:
            self.failed = True
            raise RuntimeError("lost")
        self.then(df, batch_id)


def test_fan_out_replays_without_loss_or_doubles(spark, tmp_dir):
    trips = B.trips(spark, SF_SMALL)
    to_messages(trips).repartition(3).select("value").write.text(f"{tmp_dir}/topic")
    live = SL.LiveSink(f"{tmp_dir}/state", f"{tmp_dir}/msg")
    handler = FO.FanOut(f"{tmp_dir}/stores", Failing(live))

    def run():
        src = SI.StreamSource(format="text", path=f"{tmp_dir}/topic", max_files_per_trigger=1)
        q = SI.start_foreach_batch(SI.parse_stream(SI.read_trip_stream(spark, src)), handler, f"{tmp_dir}/ck", available_now=True)
        q.awaitTermination()

    with pytest.raises(Exception):
        run()
    assert FO.committed(spark, f"{tmp_dir}/stores") == []  # written, not committed: no reader sees it
    assert FO.read_store(spark, f"{tmp_dir}/stores", "valid").count() == 0
    run()
    assert FO.committed(spark, f"{tmp_dir}/stores") == [0, 1, 2]
    valid, error = split(trips)
    for name, want in (("valid", valid), ("error", error)):
        got = FO.read_store(spark, f"{tmp_dir}/stores", name).select(*PARTS)
        assert got.exceptAll(want.select(*PARTS)).count() == 0 and want.select(*PARTS).exceptAll(got).count() == 0
    state = spark.read.parquet(f"{tmp_dir}/state").orderBy(F.desc("batch_id")).first()
    assert state.total == valid.count()
    handler(SI.parse_stream(spark.read.text(f"{tmp_dir}/topic")), 2)  # a committed batch again: nothing happens
    assert FO.read_store(spark, f"{tmp_dir}/stores", "valid").count() == valid.count()


# ---- odd amounts ----------------------------------------------------------------


@pytest.mark.parametrize("amount", ["1e25", "NaN", "Infinity", "-Infinity"])
def test_odd_amounts_go_to_quarantine(spark, amount):
    good = frame(spark).drop("case")
    n_valid, n_error = (x.count() for x in split(good))
    odd = good.withColumn("total_amount", F.lit(amount).cast("double"))
    valid, error = split(odd)
    assert n_valid > 0 and valid.count() == 0 and error.count() == n_valid + n_error
    both = split(good.unionByName(odd))[0]
    month = batch.monthly_analytics(batch.process(both, B.zones(spark, SF_SMALL)))
    assert month.where("total_revenue is null").count() == 0
