"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.session import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Bytes of one Arrow batch sent to a Python worker; with it, very long texts don't pile up.
ARROW_BATCH_BYTES = 8 << 20


#: Spark's setting that removes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and bound their batches by bytes."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [env.get("PYTHONPATH", "")])])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder and read back: the lineage ends here.

    The files are on shared storage, so a lost executor costs no recomputation
    of what came before, and the shuffles behind them are removed at once
    instead of when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so other columns can't clash; a null text is empty."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))


def _ranges(chars: list[str]) -> str:
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


#: Characters below U+0250 whose class and lower case are the same in every Unicode version.
PLAIN = [c for c in map(chr, range(0x20, 0x250)) if unicodedata.category(c) != "Cc" and c != "İ"]
LETTER = _ranges([c for c in PLAIN if unicodedata.category(c)[0] == "L"])
NUMBER = _ranges([c for c in PLAIN if unicodedata.category(c)[0] == "N"])
#: Finds a character for which the plain patterns aren't proven; such texts go through the library whole.
NOT_PLAIN = f"[^\\t\\n\\r{_ranges(PLAIN)}\\u2010-\\u2027]"


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Alternates hooking and pointer jumping: each node takes the smallest label
    among its own and its neighbours', then its label's label, until nothing
    changes. Every round is two aggregations with map-side combine, so a node
    with very many neighbours is no hot task, and is stored, so no lineage
    grows. Only a count reaches the driver.
    """
    both = stored(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), f"{name}-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        hooked = labels.select("node", "label").union(near)
        # a better label also goes to the node that carries the old label
        old = labels.select("node", F.col("label").alias("old"))
        better = hooked.groupBy("node").agg(F.min("label").alias("label"))
        up = better.join(old, "node").where("label < old").select(F.col("old").alias("node"), "label")
        # stored, so the join on labels is between plain scans and the rule for skewed joins can split a large component
        merged = stored(better.union(up).groupBy("node").agg(F.min("label").alias("label")), f"{name}-merged")
        jump = merged.alias("x").join(merged.select(F.col("node").alias("label"), F.col("label").alias("next")).alias("y"), "label", "left")
        new = stored(jump.select("node", F.coalesce("next", "label").alias("label")), f"{name}-labels")
        changed = new.join(old, "node").where("label <> old").limit(1).count()
        labels = new
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
