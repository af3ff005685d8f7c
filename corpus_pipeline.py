"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, decontam, minhash, quality, suffix
from strandlake.llm.common import table, written
from strandlake.llm.queries import vocabulary_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no quality rule rejects; null, empty and blank texts are rejected as too short."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id. Documents are linked from 80% of shared in united five-word shingles on."""
    return minhash.keep_first(docs, size=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that stand earlier; a character that a cut leaves incomplete goes too. n_chars follows the text; a null text becomes an empty one."""
    found, kept = suffix.dedup(docs, as_text=True), F.col("kept_text")
    changed = {"text": kept, "n_chars": F.length(kept).cast("bigint")}
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any word of a benchmark passage: long ones that hold one passage go too. Null and empty texts stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (joined by commas) and the text that they decode to; a null text has none."""
    return bpe.encoded(docs, vocabulary_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

#: The later stages cannot be told in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; an empty table gives an empty one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
