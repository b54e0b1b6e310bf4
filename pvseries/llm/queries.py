"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pvseries.llm import (counting, decontaminate, pieces, pii, prefix_trie, quality, recompress, repair, retrieval_packing, secret_scan,
                          sharding, simhash, vector_codes)
from pvseries.llm.common import documents, tokenizer_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(build):
    QUERIES[build.__name__] = build
    return build


@register
def op1_repair_shards(spark: SparkSession, folder: str) -> DataFrame:
    return repair.encode_to_files(documents(spark, folder), tokenizer_path("word_bpe_49k.json"))


@register
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counting.token_counts(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))


@register
def op3_distinct_chunks(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.piece_ids(documents(spark, folder), tokenizer_path("piece_bpe_32k.model"))
    return pieces.digests(coded)


@register
def op4_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    placed, _ = sharding.shard_documents(documents(spark, folder))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


@register
def op5_assigned_literals(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.find_secrets(documents(spark, folder))


@register
def op6_golay_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder))


@register
def op7_adaptive_limits(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(documents(spark, folder))


@register
def op8_context_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, folder))


@register
def op9_walk_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@register
def op10_recompression(spark: SparkSession, folder: str) -> DataFrame:
    kept = recompress.repeated_passages(documents(spark, folder))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op11_hashed_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.trie_report(spark.read.parquet(f"{folder}/conversations.parquet"))


@register
def op12_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval_packing.pack_documents(documents(spark, folder), tokenizer_path("byte_bpe_50k.json"))


@register
def op13_limb_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_report(spark.read.parquet(f"{folder}/embeddings.parquet"))


@register
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


SQL["op10_recompression"] = recompress.ORACLE
SQL["op7_adaptive_limits"] = quality.ORACLE
SQL["op11_hashed_prefix_trie"] = prefix_trie.ORACLE
SQL["op13_limb_vector_codes"] = vector_codes.ORACLE
