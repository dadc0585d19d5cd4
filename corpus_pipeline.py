"""The training-data pipeline over ``documents``: five operators, one after the other.

Each stage's result is written as Parquet below ``spark.checkpoint.dir`` and read again as the
next stage's documents; all but the last return the columns of ``documents``.

Defined cases, beside those that the operators state: a null text counts as empty and stays null;
null ids are documents of their own to every stage but near-dedup, which knows them by their text;
of equal rows near-dedup keeps one; texts of any length go through whole; an empty table gives an
empty result of the same columns; further columns of the documents, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import decontam, packing, quality, secret_scan, simhash
from usagelens.llm.common import table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Test passages are cut out; documents that are mostly such passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a placeholder."""
    return secret_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences: one row per piece, with its token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("packing", packed),
]

# XXH64, the fitted classifier and the tokeniser are beyond SQL: the stages are tested against
# brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    rows = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows, _ = written(stage(spark, rows, sf_dir), f"pipeline-{k}")
    return rows
