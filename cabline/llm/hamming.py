"""Exact top-k by Hamming distance with incremental multi-index hashing.

A 64-bit code is cut into m segments of about log2(n) bits and indexed by each
of them. Two codes within distance m * (r + 1) - 1 have a segment within r. So
round r looks up the values at distance exactly r from a query's segments; a
query is done once its k-th distance is within that bound, and the others go
into round r + 1.

Equal codes are one index entry with their k + 1 smallest ids, and equal
queries one search, so a vector that a third of all rows share costs no more
than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import prepare, stored

BITS = 64


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weight = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for b in batches:
        out = []
        for v in b.column(1):
            x = np.array([y or 0.0 for y in v.as_py()], np.float64)
            x = np.r_[x, np.zeros(-len(x) % BITS)].reshape(-1, BITS).sum(axis=0)
            out.append(int(weight[x > 0].sum(dtype=np.uint64).astype(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["id", "code"])


def binary_codes(vectors: DataFrame) -> DataFrame:
    """(id, code) of ``vectors`` (vec_id, embedding); bit i tells if coordinate i is positive.

    Of vectors longer than 64, coordinates i, i + 64, ... are added first;
    missing and null coordinates are 0. Rows without id, or with a null or
    empty vector, have no code and are left out.
    """
    prepare(vectors.sparkSession)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("id"), vectors["embedding"].cast("array<double>").alias("v"))
    return rows.where("id is not null and size(v) > 0").mapInArrow(_codes, "id long, code long")


def _layout(n: int) -> list[tuple[int, int]]:
    """(shift, bits) of the segments for n codes."""
    m = -(-BITS // max(8, min(20, max(1, n).bit_length() - 1)))
    edges = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _segment(code: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def nearest(codes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest codes to each query, itself left out.

    ``codes`` and ``queries``: (id, code). Ties go by id. Repeated (id, code)
    rows count once. With k or fewer other ids, all are returned; an empty
    table gives an empty result.
    """
    codes = stored(codes.distinct(), "codes")
    queries = stored(queries.distinct(), "query-codes")
    # the group limit is applied before the shuffle too, so a code of very many ids is no hot key
    first = codes.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    index = stored(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "code-index")
    kept = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    need, layout = min(k + 1, kept[0]), _layout(kept[1])
    m, widest = len(layout), max(b for _, b in layout)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment(F.col("code"), *s).alias("value")) for i, s in enumerate(layout)]))
    keyed = stored(index.select("code", "ids", values.alias("s")).select("s.seg", "s.value", "code", "ids"), "code-segments")

    active = queries.select(F.col("code").alias("q")).distinct().withColumn("worst", F.lit(BITS))
    best = None
    for r in range(widest + 1):
        masks = ",".join(f"{i}:{sum(1 << x for x in c)}" for i, (_, bits) in enumerate(layout) if r <= bits for c in combinations(range(bits), r))
        probe = active.select("q", "worst", F.explode(F.split(F.lit(masks), ",")).alias("x"))
        probe = probe.select("q", "worst", F.split("x", ":")[0].cast("int").alias("seg"), F.split("x", ":")[1].cast("long").alias("mask"))
        own = F.element_at(F.array(*[_segment(F.col("q"), *s) for s in layout]), F.col("seg") + 1)
        probe = probe.select("q", "worst", "seg", own.bitwiseXOR(F.col("mask")).alias("value"))
        # sizes on disk say little about exploded rows: neither side is ever broadcast
        pair = probe.join(keyed.hint("merge"), ["seg", "value"]).withColumn("x", F.col("q").bitwiseXOR(F.col("code")))
        near = [F.bit_count(_segment(F.col("x"), *s)) for s in layout]
        # a pair counts where it is found first: no segment nearer than r, none at r before this one
        earlier = F.lit(False)
        for i, d in enumerate(near):
            earlier = earlier | (d < r) | ((d == r) & (F.lit(i) < F.col("seg")))
        pair = pair.withColumn("distance", F.bit_count("x")).where(~earlier & (F.col("distance") <= F.col("worst")))
        found = pair.select("q", F.explode("ids").alias("id"), "distance")
        found = found if best is None else best.union(found)
        order = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
        best = stored(found.withColumn("r", order).where(F.col("r") <= need).select("q", "id", "distance"), "nearest")
        state = active.select("q").join(best.groupBy(F.col("q").alias("b")).agg(F.count("*").alias("n"), F.max("distance").alias("far")), F.col("q") == F.col("b"), "left")
        done = (F.coalesce("n", F.lit(0)) >= need) & (F.coalesce("far", F.lit(0)) <= m * (r + 1) - 1)
        active = stored(state.where(~done).select("q", F.when(F.col("n") >= need, F.col("far")).otherwise(BITS).alias("worst")), "open-queries")
        if active.isEmpty():
            break
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
    out = queries.join(lists, queries["code"] == lists["q"]).withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k))
    out = out.select(F.col("id").alias("query_id"), F.posexplode("near").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def search_vectors(vectors: DataFrame, k: int = 10, every: int = 20) -> DataFrame:
    """``nearest`` for the codes of ``vectors``; the queries are the rows whose id ``every`` divides."""
    codes = stored(binary_codes(vectors), "vector-codes")
    return nearest(codes, codes.where(F.col("id") % every == 0), k)


SEARCH_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id AS id,
    list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1::UBIGINT << (i - 1) ELSE 0::UBIGINT END), lambda a, b: a | b) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.id AS query_id, c.id AS neighbor_id, bit_count(xor(q.code, c.code)) AS distance FROM c AS q JOIN c ON q.id <> c.id WHERE q.id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance
FROM p QUALIFY rank <= 10
"""
