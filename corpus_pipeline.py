"""From raw documents to packed training sequences.

Each stage gets what the one before kept, written as Parquet below the shared
folder and read again, and returns the columns of ``documents``; the last
returns the places of the token pieces. Stages that drop single rows number
them first, so a row is dropped or kept for itself whatever its doc_id is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cabline.llm import decontaminate, jaccard, line_dedup, packing, quality
from cabline.llm.common import documents, stored
from cabline.llm.queries import tokenizer_path


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written before use, and the name of its column."""
    number = "row_number"
    while number in docs.columns:
        number += "_"
    return stored(docs.withColumn(number, F.monotonically_increasing_id()), name), number


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer rejects, as junk or toxic, go; each row is judged by its text."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def site_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go from the text; n_chars follows. Null texts stay null. Copies in a source count as one page."""
    pages = docs.select(docs["doc_id"].alias("id"), docs["source"].cast("string").alias("host"), F.split("text", "\n").alias("lines"), F.struct(*docs.columns).alias("row"))
    out = line_dedup.drop_boilerplate(pages, once=True)
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    new = {"text": text, "n_chars": F.coalesce(F.char_length(text), F.col("row.n_chars")).cast("long")}
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by a similarity of 0.8 on five-word shingles the one with the smallest doc_id stays.

    Rows without doc_id come after all others, of rows that share the smallest
    one any stays, identical rows included. Texts without words are linked with
    nothing, so all of them stay.
    """
    rows, number = _numbered(docs, "near-rows")
    groups = jaccard.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), size=5, num=80, den=100)
    groups = stored(groups.select(F.col("doc_id").alias("of"), F.col("component_id").alias("group")), "near-groups")
    several = groups.where(F.col("of") != F.col("group")).select("group").distinct()
    members = groups.join(several, "group").join(rows.select(F.col(number).alias("of"), "doc_id"), "of")
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "of"))["of"].alias("stays"))
    gone = stored(members.join(stays, "group").where("of <> stays").select("of"), "near-gone")
    return rows.join(gone, rows[number] == gone["of"], "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, also without doc_id; a clean row that shares its doc_id with one stays."""
    rows, number = _numbered(docs, "leak-rows")
    leaks = decontaminate.find_leaks(rows.select(F.col(number).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(leaks.select(F.col("doc_id").alias("of")).distinct(), "leak-gone")
    return rows.join(gone, rows[number] == gone["of"], "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 4096."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", site_line_dedup),
    ("ngram_jaccard_join", near_duplicate_removal),
    ("benchmark_decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The scorer, the tiling and the tokenizer have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
