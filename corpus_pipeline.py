"""A corpus pipeline: quality rules, near-duplicate documents, repeated spans, packing.

Each stage takes (spark, docs, sf_dir) and what it returns is written and read again as the next stage's docs. All but
the last return the columns of documents.

Defined results: null, empty and short texts fail the quality rules' base and go; where a stage is called by itself on such rows, near_dedup and substring_dedup
keep them. Rows that share an id are told apart by their texts; of rows alike in both one stays. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import minhash_dedup, packing, quality, spans
from tidemark.llm.common import free, written
from tidemark.llm.queries import table, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more) stays."""
    return minhash_dedup.drop_near_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of 50 words or more that a document with a smaller id has are cut out; a document left without text goes."""
    (had,) = free(docs, "_had")
    cut = spans.remove_repeats(docs.withColumn(had, F.coalesce(F.col("text") != "", F.lit(False))))
    return cut.where(~(F.col(had) & (F.col("text") == ""))).drop(had)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality_rules), ("minhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", pack)]

#: Tokenization has no SQL form; tests compare the whole run with plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
