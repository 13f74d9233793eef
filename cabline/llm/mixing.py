"""Mixing sources to target weights by hash thresholds.

Every document has a hash of 60 bits. Of a source, all documents up to a first
threshold are taken and those up to a second, smaller one are taken twice, so
a target between one and two times the source's size moves the second
threshold and a smaller target the first. A threshold is found without
sorting: words are added up by source and hash bucket, the bucket in which the
budget ends is the boundary, and only its documents are added up again by the
next bits, until it holds one hash value. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cabline.llm.common import stored

#: Bits of the hash, and those that one histogram tells apart: 1,024 buckets for each source.
HASH_BITS, STEP_BITS = 60, 10
#: What the sources weigh, by rank, repeating; words of the mix for each word of the sources; copies of a document at most.
WEIGHTS, SHARE, COPIES = (5, 2, 1), 1.5, 2

# FIXED VALUE: a word.
WORD = r"[^\x20\x09-\x0D]+"


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the words of each text and the hash of doc_id and text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    key = F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), text)
    h = F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), h.alias("h"))


def weighed(sources: DataFrame, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``weight``, by rank in the order of code points, null last.

    Ranked in two levels: rows of a sorted range, then the ranges' counts, so the sources needn't fit one task.
    """
    last = [F.col("source").isNull(), F.col("source")]
    at = F.monotonically_increasing_id()
    ordered = stored(sources.repartitionByRange(*last).sortWithinPartitions(*last).withColumn("at", at), "mix-ordered")
    ordered = ordered.withColumns({"range": F.shiftright("at", 33), "own": F.col("at").bitwiseAND((1 << 33) - 1)})
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ordered.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("before"))  # a row for each range
    rank = (F.col("before") + F.col("own")) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int"))
    return ordered.join(ranges, "range").select("source", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: ``share`` of all sizes by weight, at most ``copies`` times a
    source's size, what exceeds it shared among the others. Each round brings two sums to the driver."""
    level, total = 0.0, sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.col("source_size") * copies < F.lit(level) * F.col("weight")
        weight, size = sources.agg(F.sum(F.when(~full, F.col("weight"))), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0))).first()
        new = (share * total - copies * size) / weight if weight else level
        if new <= level:
            return sources.withColumn("target", F.least((F.col("source_size") * copies).cast("double"), F.lit(level) * F.col("weight")))
        level = new


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, most): rows with h up to ``most`` come nearest to the source's budget; no row for a source taken whole.

    ``rows``: source, size, h; ``budgets``: source, budget. The row at which
    the budget ends is in if that is nearer; rows with the same hash go
    together. Each round reads the rows of the boundary buckets only.
    """
    rows, found = rows.where("size > 0").select("source", "size", "h"), []
    state = budgets.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("bucket"), F.col("budget").cast("double").alias("budget"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        part = F.shiftright("h", shift + STEP_BITS) if shift + STEP_BITS < HASH_BITS else F.lit(0).cast("long")
        inside = rows.join(state, _same(rows["source"], state["of"]) & (part == state["bucket"]))
        sums = inside.groupBy("source", "budget", F.shiftright("h", shift).alias("next")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("next"))  # 1,024 rows at most
        edge = sums.withColumn("upto", upto).where("upto > budget").groupBy("source").agg(F.min(F.struct("next", "size", "upto", "low", "high", "budget")).alias("e"))
        edge = stored(edge.select("source", "e.*"), "mix-edge")
        nearer = F.col("upto") - F.col("budget") < F.col("budget") - (F.col("upto") - F.col("size"))
        found.append(edge.where("low = high").select("source", F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("most")))
        state = edge.where("low < high").select(F.col("source").alias("of"), F.col("next").alias("bucket"), (F.col("budget") - (F.col("upto") - F.col("size"))).alias("budget"))
        if state.isEmpty():
            break
    return reduce(DataFrame.union, found)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    size: words of the text, a null one has none; source_size: of all rows of
    the source, null is a source; target: see ``targets``; taken: no, one or
    two times size. The sum of a source's taken words differs from its target
    by half a row's size at most. Rows that share doc_id and text are taken
    alike, so there by half of what they add up to; a null doc_id counts as an
    empty one. Documents without words take nothing. An empty table gives an
    empty result; other columns are left out.
    """
    rows = stored(sized(docs), "mix-rows")
    sources = stored(targets(weighed(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), share), "mix-sources")
    whole = F.col("target") >= F.col("source_size")
    budgets = sources.select("source", F.when(whole, F.col("target") - F.col("source_size")).otherwise(F.col("target")).alias("budget"))
    most = thresholds(rows, budgets).withColumnRenamed("source", "of")
    plan = sources.join(most, _same(sources["source"], most["of"]), "left")
    plan = stored(plan.select(F.col("source").alias("of"), "source_size", "target", whole.alias("whole"), F.coalesce("most", F.lit((1 << HASH_BITS) - 1)).alias("most")), "mix-plan")
    out = rows.join(plan, _same(rows["source"], plan["of"]))
    copies = F.col("whole").cast("long") + (F.col("h") <= F.col("most")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s),
p AS (SELECT *, 2 * source_size < w * (1.5::DOUBLE * total - 2 * coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM o),
v AS (SELECT (1.5::DOUBLE * CAST(max(total) AS DOUBLE) - CAST(2 * coalesce(sum(source_size) FILTER (WHERE capped), 0) AS DOUBLE)) / sum(w) FILTER (WHERE NOT capped) AS level FROM p),
t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), level * w) AS target FROM p, v),
b AS (SELECT *, target >= source_size AS whole, CASE WHEN target >= source_size THEN target - source_size ELSE target END AS budget FROM t),
g AS (SELECT source, h, sum(size) AS g FROM d WHERE size > 0 GROUP BY ALL),
u AS (SELECT source, h, g, sum(g) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
e AS (SELECT u.source, min(h) AS edge FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source WHERE upto > budget GROUP BY u.source),
m AS (SELECT e.source, CASE WHEN upto - budget < budget - (upto - g) THEN edge ELSE edge - 1 END AS most
  FROM e JOIN u ON u.source IS NOT DISTINCT FROM e.source AND u.h = e.edge JOIN b ON b.source IS NOT DISTINCT FROM e.source)
SELECT d.doc_id, d.source, d.size, b.source_size, b.target, d.size * (CAST(b.whole AS INTEGER) + CAST(m.most IS NULL OR d.h <= m.most AS INTEGER)) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""
