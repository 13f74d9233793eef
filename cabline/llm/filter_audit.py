"""Interaction of document filters: what each removes, alone and in every order.

Each row gets a mask of the filters that it fails. Four are told from its text
alone. The fifth, a copy of a text with a smaller doc_id, needs other rows, so
a counting Bloom filter goes first: tasks count the cells of their texts up to
two, the partial counts are merged cell by cell, and a text that has a cell
counted once has no copy anywhere. Only the texts that are left are shuffled,
whole, for the smallest doc_id of each. The masks are then added up by part;
every order's report is a sum over at most 32 masks.

The filter is sized by the number of rows, up to MOST_CELLS (64 MB as it is
sent to the tasks). Beyond about a hundred million rows it clears fewer texts
and more are shuffled; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cabline.llm.common import prepare, stored

FILTERS = "ABCDE"
#: Cells that a text counts in; cells for each row; bounds of their number, powers of two.
HASHES, CELLS_A_ROW, LEAST_CELLS, MOST_CELLS = 3, 8, 1 << 16, 1 << 29
#: Cells merged together.
SEGMENT = 1 << 20
#: Cell counts that a task holds before it sends them.
HELD = 1 << 20

# FIXED VALUES: what words and marks are.
SPACE, UPPER_REST, MARKS = r"[\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"


def cells_of(h: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES cells of each 64-bit hash, one row for each hash function."""
    h = h.view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)  # odd, so the cells of a text differ
    return np.stack([(h + np.uint64(i) * step) & np.uint64(cells - 1) for i in range(HASHES)])


def _partial(cells: int):
    """(segment, cells): the cells that the task's texts count in, shifted left by one; the last bit: more than once."""

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        segment, first = np.unique(cell // SEGMENT, return_index=True)
        packed = ((cell % SEGMENT) << np.uint64(1) | (n > 1)).astype("<u4")
        parts = [packed[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(cell)])]
        return pa.RecordBatch.from_arrays([pa.array(segment.astype(np.int32)), pa.array(parts, pa.binary())], names=["segment", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(cells_of(b.column(0).to_numpy(), cells).ravel())
            size += len(held[-1])
            if size >= HELD:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, bits): the cells of a segment counted twice or more. Rows come sorted by segment; one segment is held."""
    at, once, more = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(more).tobytes()], pa.binary())], names=["segment", "bits"])

    for b in batches:
        for segment, packed in zip(b.column(0).to_pylist(), b.column(1)):
            if segment != at:
                if at is not None:
                    yield done()
                at, once[:], more[:] = segment, False, False
            x = np.frombuffer(packed.as_py(), "<u4")
            cell = x >> 1
            more[cell] |= once[cell] | (x & 1).astype(bool)
            once[cell] = True
    if at is not None:
        yield done()


def repeated_cells(hashes: DataFrame, cells: int) -> np.ndarray:
    """Of ``hashes`` (h long), a bit for each cell that two or more rows count in; cells / 8 bytes on the driver."""
    parts = hashes.mapInArrow(_partial(cells), "segment int, cells binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge, "segment int, bits binary")
    out = np.zeros(max(cells, SEGMENT) // 8, np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return out[: cells // 8]


def possible_repeat(docs: DataFrame, text: Column, most_cells: int = MOST_CELLS):
    """A function of a column of ``xxhash64(text)``: false only where no other row of ``docs`` has the text."""
    spark = docs.sparkSession
    n = max(LEAST_CELLS, CELLS_A_ROW * docs.count())
    cells = min(most_cells, 1 << (n - 1).bit_length())
    sent = spark.sparkContext.broadcast(repeated_cells(docs.select(F.xxhash64(text).alias("h")), cells))

    @F.pandas_udf(T.BooleanType())
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = sent.value
        for h in batches:
            at = cells_of(h.to_numpy(), cells)
            yield pd.Series(((bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=0))

    return look


def _own_mask(words: Column, text: Column) -> Column:
    """The bits of the filters A to D, which a text fails by itself."""
    n = F.size(words)
    fails = [
        n < 50,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * n,
        F.lit(100) * F.char_length(F.regexp_replace(text, UPPER_REST, "")) > F.lit(5) * F.char_length(text),
        F.regexp_like(text, F.lit(MARKS)),
    ]
    return sum((F.when(x, F.lit(1 << k)).otherwise(0) for k, x in enumerate(fails)), F.lit(0))


def failed_filters(docs: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs`` (doc_id, text, source): which filters it fails.

    mask: A 1, B 2, C 4, D 8, E 16. part: the source, a null one is empty. A
    null text is empty, and empty texts are copies of each other. A row
    without doc_id is no copy and makes none; rows that share a doc_id don't
    make each other copies, whatever smaller doc_id does. An empty table gives
    an empty result; other columns are left out.
    """
    prepare(docs.sparkSession)
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    look = possible_repeat(plain, F.col("text"), most_cells)
    maybe = plain.withColumn("maybe", look(F.xxhash64("text")))
    words = F.filter(F.split("text", SPACE), lambda x: x != "")
    rows = maybe.select("doc_id", "part", "text", words.alias("words"), F.when(F.col("maybe"), F.unhex(F.sha2("text", 256))).alias("name"))
    rows = stored(rows.select("doc_id", "part", _own_mask(F.col("words"), F.col("text")).alias("mask"), "name"), "audit-rows")
    # whole texts are compared; the digest then only names a group
    first = maybe.where("maybe and doc_id is not null").groupBy("text").agg(F.min("doc_id").alias("first"))
    first = stored(first.select(F.unhex(F.sha2("text", 256)).alias("name"), "first"), "audit-first")
    alone = rows.where("name is null").select("doc_id", "part", "mask")
    several = rows.where("name is not null").join(first, "name", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return alone.union(several.select("doc_id", "part", (F.col("mask") + copy).alias("mask")))


def mask_counts(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of ``failed`` (doc_id, part, mask) and ``labels`` (doc_id, quality, toxic).

    A document is good or toxic if any of its labels says so; labels without doc_id or of no document count nothing.
    """
    yes = lambda c: F.max(F.coalesce((labels[c] == 1).cast("int"), F.lit(0))).alias(c)
    known = labels.where(labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("label_id")).agg(yes("quality"), yes("toxic"))
    rows = failed.join(known, failed["doc_id"] == known["label_id"], "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps() -> str:
    """Every step of every order: the order, the step, its filter's bit, the bits of the filters before."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(f"{''.join(order)}:{k}:{bit}:{before}")
            before |= bit
    return ",".join(out)


def order_report(counts: DataFrame) -> DataFrame:
    """Every part, order and step with its counts, from ``mask_counts``' rows."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = parts.select("part", "masks", F.explode(F.split(F.lit(_steps()), ",")).alias("s")).withColumn("s", F.split("s", ":"))
    rows = rows.select("part", "masks", F.col("s")[0].alias("filter_order"), F.col("s")[1].cast("int").alias("step"), F.col("s")[2].cast("int").alias("bit"), F.col("s")[3].cast("int").alias("before"))

    def total(which, value=lambda x: x["n"]) -> Column:
        return F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda a, x: a + value(x))

    fails = lambda x: x["mask"].bitwiseAND(F.col("bit")) != 0
    past = lambda x: x["mask"].bitwiseAND(F.col("before")) == 0
    removed = lambda x: fails(x) & past(x)
    # of the 120 orders, the filter comes first among the mask's filters in this many
    orders = lambda x: (F.lit(120) / F.bit_count(x["mask"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda x: past(x) & ~fails(x)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda x: fails(x) & ~past(x)).alias("redundant"),
        total(lambda x: x["mask"] == F.col("bit")).alias("unique_fails"),
        total(removed, lambda x: x["good"]).alias("good_lost"),
        total(removed, lambda x: x["toxic"]).alias("toxic_lost"),
        total(fails, lambda x: x["n"] * orders(x)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of ``order_report`` over every row of ``docs`` (doc_id, text, source); see ``failed_filters`` and ``mask_counts``.

    Repeated rows count as often as they occur. An empty table has no part and gives an empty result.
    """
    return order_report(mask_counts(failed_filters(docs), labels))


AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS lo FROM d),
m AS (SELECT doc_id, part,
    CASE WHEN len(ws) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '{UPPER_REST}', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '{MARKS}') THEN 8 ELSE 0 END + CASE WHEN doc_id > lo THEN 16 ELSE 0 END AS mask FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum([0] || list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
