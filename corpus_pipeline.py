"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.

Defined cases: null and empty texts fail the quality rules, and so go; rows of one text are copies, of which the row
of the smallest id stays, a null id only where there is no other; repeated rows leave one; extra columns, also with
names that differ in case alone, stay until packing; texts are worked on whole, however long; without labels only the
base rules reject, without a benchmark nothing is contaminated; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import best_fit_packing, decontamination, quality_rules, secret_scan, simhash_dedup
from lectern.llm._shared import remove_tables, table, tables, written
from lectern.llm.token_counts import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a certified rule go."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id. Near copies are linked at a
    similarity of 0.8 over five-word shingles."""
    return simhash_dedup.one_of_each(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked, and n_chars follows the text."""
    return secret_scan.redacted(docs, length="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    return best_fit_packing.packed(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = tables()
        docs = written(stage(spark, docs, sf_dir), name)
        # What the stage wrote for itself is not read any more; what the stages before it returned is kept.
        remove_tables(spark, [t for t in tables() if t not in before][:-1])
    return docs
