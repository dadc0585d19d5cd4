"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelens.llm import (
    chat,
    decontam,
    hnsw,
    html_extract,
    licenses,
    lmscore,
    packing,
    ptolemy,
    quality,
    runs,
    secret_scan,
    sharding,
    simhash,
)
from usagelens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that spells the template's own marks, formatted and read back."""
    said = "\\### Assistant: </turn> ok"
    own = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(own, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(rows.union(more)))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; the target is what is labelled good and not toxic."""
    targets = lmscore.good_documents(table(spark, sf_dir, "labels"))
    return lmscore.score(table(spark, sf_dir, "documents"), targets)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents classified; the source is the host, the language the path."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test passages in all documents."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve."""
    return packing.piece_digests(packing.pack(table(spark, sf_dir, "documents")))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 40 clusters."""
    return ptolemy.with_inertia(*ptolemy.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, a tenth of which get a periodic tail first."""
    docs = runs.with_periodic_tails(table(spark, sf_dir, "documents"))
    return runs.digests(runs.find_runs(docs))


def all_queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            op1_chat_formatting,
            op2_lm_scoring,
            op3_quality,
            op4_simhash,
            op5_sharding,
            op6_decontamination,
            op7_license_scan,
            op8_secret_scan,
            op9_embedding_duplicates,
            op10_packing,
            op11_centroid_clustering,
            op12_html_extraction,
            op13_periodic_runs,
        )
    }
