"""The queries of this subpackage: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import content_store, embedding_dedup, lm_score, minhash_dedup, packing, quality, segment, sharding, spans, warc
from .oracles import oracles

SHARDS, PERCENT = 24, 85


def vocabulary(name: str) -> str:
    """Where the public tokenizers' files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents"))


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.score(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.captures(table(spark, folder, "pages"))
    number = F.regexp_extract("response.refers_to", r"^urn:capture:(-?\d+)$", 1)
    return found.select(
        F.regexp_extract("metadata.fields", r"page_id: (-?\d*)", 1).try_cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        number.try_cast("long").alias("refers_to"),
        F.col("response.intact").alias("intact"),
        F.col("request.uri").alias("request_uri"),
        F.col("requests").alias("n_requests"),
        F.col("metadatas").alias("n_metadatas"),
    )


def op4_content_store(spark: SparkSession, folder: str) -> DataFrame:
    return content_store.store_report(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, folder, "embeddings"))


def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard(table(spark, folder, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_documents(table(spark, folder, "documents"), PERCENT)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op9_nbest(spark: SparkSession, folder: str) -> DataFrame:
    return segment.segment(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return spans.span_report(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_score, op3_warc, op4_content_store, op5_embedding_dedup, op6_sharding, op7_minhash_dedup, op8_packing, op9_nbest, op10_substring_dedup)}
ORACLES = oracles(SHARDS, PERCENT)
