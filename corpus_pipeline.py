"""Corpus pipeline: quality rules, near-duplicates, decontamination, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; ``run`` writes every
result as Parquet in the shared folder and reads it again, so a lost executor recomputes one stage
at most. All stages but the last return the columns of ``documents``.

Every stage takes empty tables (and returns one), null and repeated ids, null, empty and very long
texts, repeated rows and further columns of any name and type, which stay as they are. Rows are told
apart by id and text: equal rows get one verdict, and of equal rows near-dedup keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqdrift.config import materialize
from seqdrift.llm import decontaminate, pii, quality_rules, sentencepieces, simhash
from seqdrift.llm.common import read


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null text has no words and is rejected, as are short ones."""
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(read(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component: the smallest id, null ids last, ties by a digest of the text."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; without a benchmark all of them."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; null texts stay null, ``n_chars`` is counted again."""
    return pii.redact(docs, pii.fit(docs))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; a null or empty text has none."""
    return sentencepieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("sentencepiece_tokens", tokens_stage),
]

#: The first stage's n-gram hashes can't be expressed in SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
