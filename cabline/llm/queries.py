"""The registered queries of this folder, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cabline.llm import collocations, decontaminate, filter_audit, hamming, jaccard, line_dedup, mixing, packing, quality, repeats, secrets, sharding, token_counts
from cabline.llm.common import documents


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers, installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir), size=4, num=85, den=100)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_digest(repeats.remove_repeats(documents(spark, sf_dir), length=50))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), limit=512)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.search_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=20)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), shards=40)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(documents(spark, sf_dir), least=10, top=2000, cover=50)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), weights=(5, 2, 1), share=1.5)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_secret_scan,
        op3_suffix_dedup,
        op4_token_counts,
        op5_quality_classifier,
        op6_decontamination,
        op7_best_fit_packing,
        op8_hamming_search,
        op9_line_dedup,
        op10_sharding,
        op11_phrase_collocations,
        op12_source_mixing,
        op13_filter_audit,
    )
}

ORACLE = {
    "op8_hamming_search": hamming.SEARCH_SQL,
    "op9_line_dedup": line_dedup.PAGES_SQL,
    "op11_phrase_collocations": collocations.PHRASES_SQL,
    "op12_source_mixing": mixing.MIX_SQL,
    "op13_filter_audit": filter_audit.AUDIT_SQL,
}
