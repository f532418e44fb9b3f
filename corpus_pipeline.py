"""The training-corpus pipeline: filter, deduplicate, decontaminate, redact, pack.

Every stage works on all that its predecessor kept, and is written as Parquet
and read again for the next. All but the last keep the columns of documents,
whatever they are named.

Edge cases, the same in all stages: a null or word-less text is rejected by the
quality rules; a null doc_id is kept as a document like any other; repeated rows
are near duplicates of each other and leave one; rows that share an id but not a
text are separate documents; a text of any length is read whole; an empty table
gives an empty result, and an empty benchmark rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from msgrisk.llm import decontaminate, packing, quality, secrets, simhash
from msgrisk.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest id."""
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go: eight words in a row, or two whole shorter items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; no document goes."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenised packing cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
