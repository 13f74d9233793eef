import pytest

from cabline.operators import serving as S


def _routes(spark):
    rows = [
        (2023, 1, "A", "B", 10), (2023, 1, "A", "C", 10), (2023, 1, "A", "A", 50), (2023, 1, "A", "D", 3),
        (2023, 1, "B", "A", 7), (2023, 1, "C", "A", 9), (2023, 1, "D", "A", 1), (2023, 2, "A", "B", 99),
        (2023, 1, "E", "A", 2), (2023, 1, "F", "A", 2), (2023, 1, "A", "E", 1), (2023, 1, "A", "F", 1),
    ]
    return spark.createDataFrame(rows, "year int, month int, pickup_zone string, dropoff_zone string, trip_count long")


def _monthly(spark):
    rows = [(y, m, y * 100 + m) for y in (2022, 2023, 2024) for m in range(1, 13)]
    return spark.createDataFrame(rows, "year int, month int, trip_count long")


def test_time_range(spark):
    m = _monthly(spark)
    got = [(r.year, r.month) for r in S.time_range(m, 2022, 11, 2023, 2).collect()]
    assert got == [(2022, 11), (2022, 12), (2023, 1), (2023, 2)]
    assert S.time_range(m, 2024, 1, 2023, 5).count() == 0  # inverted: empty
    assert S.time_analytics(m, 2023, 5).count() == 1
    assert [(r.year, r.month) for r in S.time_analytics(m).limit(2).collect()] == [(2024, 12), (2024, 11)]
    assert S.year_range(m, 2023, 2024).count() == 24


def test_top_routes_ties_and_popular(spark):
    r = _routes(spark)
    top = [(x.dropoff_zone, x.trip_count) for x in S.top_routes(r, 2023, 1, "A", "pickup").collect()]
    assert top == [("A", 50), ("B", 10), ("C", 10), ("D", 3), ("E", 1)]
    pop = S.popular_routes(r, 2023, 1, "A").collect()
    pairs = [(x.pickup_zone, x.dropoff_zone) for x in pop]
    assert ("A", "A") not in pairs  # self-loop removed
    assert len(pairs) == len(set(pairs))  # first occurrence kept
    assert pairs[:4] == [("A", "B"), ("A", "C"), ("A", "D"), ("A", "E")]
    assert pairs[4:] == [("C", "A"), ("B", "A"), ("E", "A"), ("F", "A")]


def test_routes_by_zone_and_dropoff_only(spark):
    r = _routes(spark)
    z = S.routes_by_zone(r, "B").collect()
    assert sorted((x.pickup_zone, x.dropoff_zone, x.match_order) for x in z) == [
        ("A", "B", 1), ("A", "B", 1), ("B", "A", 0)]
    assert S.dropoff_only(r, "A").filter("pickup_zone = 'A'").count() == 0
    all_zone = S.top_routes_all(r, k=2)
    assert all_zone.filter("direction = 'pickups' AND zone = 'A' AND year = 2023 AND month = 1").count() == 2


def test_page_bounds(spark):
    df = _monthly(spark)
    p = S.page(df, ["year", "month"], offset=10, limit=5).collect()
    assert [(x.year, x.month) for x in p] == [(2022, 11), (2022, 12), (2023, 1), (2023, 2), (2023, 3)]
    assert all(x.total == 36 for x in p)
    assert S.page(df, ["year"], offset=100, limit=5).count() == 0
    with pytest.raises(ValueError):
        S.page(df, ["year"], offset=-1)
    with pytest.raises(ValueError):
        S.page(df, ["year"], limit=100001)
