"""The training-data pipeline over `documents`: stages of the operators in engram.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import common, decontamination, near_duplicates, packing, suffix_dedup
from engram.llm import toxicity as toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; null and empty texts, repeated rows and null doc_ids as in `without_toxic`."""
    return toxic.without_toxic(docs, common.read(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8. Null and empty texts stay, one of each doc_id;
    of equal rows one stays."""
    return near_duplicates.one_of_each(docs, size=5, percent=80)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that repeat anywhere are cut out of the texts; all documents stay, null texts stay null."""
    return suffix_dedup.without_repeats(docs, length=200)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a test item go; null and empty texts leak nothing."""
    return decontamination.without_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 1,024 tokens, with its sequence and its place there; a null text is one end token."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and tokenizers have no SQL form; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written as Parquet and read by the next.

    Extra columns of any name pass through all stages but the last, and an empty table gives no rows.
    """
    scratch = common.Scratch(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
