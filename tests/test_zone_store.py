"""Zone requests on the zone-clustered table: the same rows, from one folder."""

import re

import pytest

from cabline.operators import serving as S
from cabline.operators import zone_store as Z
from cabline.plans.registry import stored_routes
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zones"))
    routes = stored_routes(spark, SF_SMALL)
    Z.write_zone_store(routes, path, buckets=16)
    return path, routes


@pytest.mark.parametrize("zone", ["NATION_7", "NATION_0", "no such zone", ""])
def test_zone_routes(spark, store, zone):
    path, routes = store
    want = S.routes_by_zone(routes, zone)
    got = Z.zone_routes(spark, path, zone, buckets=16).select(*want.columns)
    assert list(map(str, got.collect())) == list(map(str, want.collect()))


@pytest.mark.parametrize("direction", ["pickup", "dropoff"])
def test_zone_top(spark, store, direction):
    path, routes = store
    top = routes.groupBy("year", "month", f"{direction}_zone").count().orderBy("count", ascending=False).first()
    want = S.top_routes(routes, top[0], top[1], top[2], direction, k=2)
    got = Z.zone_top(spark, path, top[2], top[0], top[1], direction, k=2, buckets=16).select(*want.columns)
    assert list(map(str, got.collect())) == list(map(str, want.collect())) and want.count() == 2


def test_most_files_are_skipped(spark, store):
    path, _ = store
    plan = Z.zone_routes(spark, path, "NATION_7", buckets=16)._jdf.queryExecution().executedPlan().toString()
    scan = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert re.search(rf"bucket#\d+ = {Z.bucket_of(spark, 'NATION_7', 16)}\b", scan)
    assert len({f.split("bucket=")[1].split("/")[0] for f in spark.read.parquet(path).inputFiles()}) > 8


def test_null_zones_stand_under_none(spark, tmp_dir):
    rows = [(1996, 3, "A", None, 1), (1996, 3, None, "A", 2), (1996, 3, "A", "A", 3), (1996, 3, None, None, 4)]
    df = spark.createDataFrame(rows, "year int, month int, pickup_zone string, dropoff_zone string, trip_count long")
    Z.write_zone_store(df, tmp_dir)
    got = [(r.match_order, r.trip_count) for r in Z.zone_routes(spark, tmp_dir, "A").collect()]
    want = [(r.match_order, r.trip_count) for r in S.routes_by_zone(df, "A").collect()]
    assert sorted(got) == sorted(want) == [(0, 1), (0, 3), (1, 2)]
