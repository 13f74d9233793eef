"""Many monthly source files in one scan, though their types drift.

The publisher's months don't share a schema: a column is an integer in one
file, a double in the next, spelled otherwise or absent in a third. One scan
over all of them fails or nulls. Here the months are grouped by the schema that
their footers state; each group is one scan with that schema, standardised
by one projection, and the groups are united. So the plan has as many scans
as there are different schemas, not as many as months, and a filter still
reaches each scan: a column that has its standard type already isn't cast.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cabline.schema import TRIP_SCHEMA
from cabline.session import child_names
from cabline.sources.trips import standardize, trip_file

Month = tuple[int, int]
FOOTERS_AT_ONCE = 16  # small jobs that the driver waits for together


def available_months(spark: SparkSession, root: str, taxi_type: str, first: Month | None = None, last: Month | None = None) -> list[Month]:
    """The months that ``root`` has files of, by name alone, from ``first`` to ``last`` (both included)."""
    name = re.compile(re.escape(taxi_type) + r"_tripdata_(\d{4})-(\d{2})\.parquet")
    found = (name.fullmatch(n) for n in child_names(spark, root))
    months = sorted((int(m[1]), int(m[2])) for m in found if m)
    return [m for m in months if (first is None or m >= first) and (last is None or m <= last)]


def footer_schema(spark: SparkSession, path: str) -> StructType:
    """The schema of one month's file or folder."""
    return spark.read.option("recursiveFileLookup", "true").parquet(path).schema


def group_by_schema(spark: SparkSession, paths: list[str]) -> list[tuple[StructType, list[str]]]:
    """The paths by their schema; groups and paths keep the given order."""
    groups: dict[str, tuple[StructType, list[str]]] = {}
    with ThreadPoolExecutor(FOOTERS_AT_ONCE) as pool:
        schemas = list(pool.map(lambda path: footer_schema(spark, path), paths))
    for path, schema in zip(paths, schemas):
        groups.setdefault(schema.json(), (schema, []))[1].append(path)
    return list(groups.values())


def read_drifting(spark: SparkSession, paths: list[str], schema: StructType = TRIP_SCHEMA, renames: dict | None = None) -> DataFrame:
    """All rows of ``paths`` in the standard schema.

    A value that its column's standard type can't hold is null, as in
    ``standardize``; a column that a file lacks is null for its rows. A missing
    path fails. Without paths the result is empty."""
    if not paths:
        return spark.createDataFrame([], schema)
    # a folder given as such names no partition columns, whatever it is called
    scans = [spark.read.schema(s).option("recursiveFileLookup", "true").parquet(*group) for s, group in group_by_schema(spark, paths)]
    return reduce(DataFrame.unionByName, [standardize(scan, schema, renames) for scan in scans])


def read_months(spark: SparkSession, root: str, taxi_type: str, first: Month | None = None, last: Month | None = None) -> DataFrame:
    """S1 + S2 over a span of months; files outside it aren't opened. No month in the span fails, as one missing month does."""
    months = available_months(spark, root, taxi_type, first, last)
    if not months:
        raise FileNotFoundError(f"no {taxi_type} months from {first} to {last} below {root}")
    return read_drifting(spark, [trip_file(root, taxi_type, y, m) for y, m in months])
