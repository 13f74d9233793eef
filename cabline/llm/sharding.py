"""Shards of near-equal bytes that keep equal texts together.

Groups of equal texts are the atoms. So that the partition problem has a
bounded size whatever the table's, atoms smaller than 1/512 of a shard are
gathered in hash buckets, which gives at most 2 * 512 * shards units with
their byte sums. Atoms over a shard's fair share get shards of their own. The
rest is put in an order in which larger units start shards and small ones fill
them, and cut by minimax contiguous partition: a binary search for the
smallest capacity that a greedy walk meets with the shards left. Slots are
numbered in two levels, so no shard is one task. DataFrame functions only.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import id_text, stored

#: Hash buckets of small atoms for each shard.
BUCKETS = 512
#: Rows of a shard numbered by one task, on average, at most.
CELL_ROWS = 200_000


def cut(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the ordered ``sizes``: contiguous, the largest shard as small as can be."""

    def walk(capacity: int) -> list[int]:
        at, load, out = 0, 0, []
        for s in sizes:
            if load and load + s > capacity:
                at, load = at + 1, 0
            load += s
            out.append(at)
        return out

    low, high = max([*sizes, -(-sum(sizes) // max(1, shards))], default=0), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if walk(mid)[-1] < shards:
            high = mid
        else:
            low = mid + 1
    return walk(low)


def assign(units: dict[int, int], shards: int) -> dict[int, int]:
    """unit -> shard for unit -> bytes."""
    left = sorted(units.items(), key=lambda x: (-x[1], x[0]))
    total, own = sum(units.values()), []
    while left and len(own) < shards - 1 and left[0][1] * (shards - len(own)) > total:
        own.append(left.pop(0))
        total -= own[-1][1]
    rest = shards - len(own)
    large = [x for x in left if x[1] * 64 * rest > total]
    bins = [(0, k, []) for k in range(rest)]
    for unit, size in large:
        load, k, has = heapq.heappop(bins)
        heapq.heappush(bins, (load + size, k, [*has, (unit, size)]))
    small, ordered = left[len(large) :][::-1], []
    for load, k, has in sorted(bins, key=lambda x: x[1]):
        ordered += has
        while small and (load + small[-1][1] / 2) * rest <= total:
            ordered.append(small.pop())
            load += ordered[-1][1]
    ordered += small[::-1]
    out = dict(zip([u for u, _ in ordered], cut([s for _, s in ordered], rest)))
    return out | {u: rest + k for k, (u, _) in enumerate(own)}


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size: UTF-8 bytes of the text plus 16; the law is ``bytes``, so grown_shard
    is null. A null text counts as an empty one and shares its group. Repeated
    rows are rows of their own in one group, a null doc_id stays null, an empty
    table gives an empty result, other columns are left out. To the driver come
    2 * 512 * shards units at most.
    """
    text = F.encode("text", "UTF-8")
    rows = stored(
        id_text(docs).select("doc_id", (F.octet_length("text").cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group")), "shard-rows"
    )
    groups = stored(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "shard-groups")
    total, n = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = BUCKETS * shards
    heavy = groups.where(F.col("size") * buckets > F.lit(total)).select("group", F.xxhash64("group").alias("own"))
    bucket = F.pmod(F.xxhash64("group"), F.lit(buckets))
    units = groups.withColumn("unit", F.when(F.col("size") * buckets > F.lit(total), F.xxhash64("group")).otherwise(bucket))
    place = assign({r["unit"]: r["size"] for r in units.groupBy("unit").agg(F.sum("size").alias("size")).collect()}, shards)
    listed = F.explode(F.split(F.lit(",".join(f"{u}:{s}" for u, s in place.items())), ","))
    table = docs.sparkSession.range(1).select(listed.alias("x")).where("x <> ''")
    table = table.select(F.split("x", ":")[0].cast("long").alias("unit"), F.split("x", ":")[1].cast("int").alias("shard"))
    # both lists are bounded by the number of units
    placed = rows.join(F.broadcast(heavy), "group", "left").withColumn("unit", F.coalesce("own", bucket)).join(F.broadcast(table), "unit")
    cells = max(8, -(-n // (shards * CELL_ROWS)))
    placed = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell"))
    counts = placed.groupBy("shard", "cell").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("own", own).join(counts.select("shard", "cell", F.coalesce(before, F.lit(0)).alias("before")), ["shard", "cell"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
