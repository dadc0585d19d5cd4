"""Export of documents in their original format."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.operators.normalize import to_documents


def export_one(cur: DataFrame, name: str, pretty: bool = False) -> DataFrame:
    """The document of one entity; no row when it is unknown."""
    return to_documents(cur.filter(F.col("bucket_name") == name), pretty)


def export_all(cur: DataFrame, limit: int | None = None, pretty: bool = False) -> DataFrame:
    """All documents by name."""
    ordered = cur.orderBy("bucket_name")
    return to_documents(ordered if limit is None else ordered.limit(limit), pretty)


def export_text(cur: DataFrame, name: str | None = None, pretty: bool = True) -> DataFrame:
    """Documents as indented or compact text; an unknown name gives ``{}``."""
    if name is None:
        return export_all(cur, pretty=pretty)
    # one row at most: an aggregate over nothing still returns a row
    found = F.coalesce(F.max("document"), F.lit("{}"))
    return export_one(cur, name, pretty).agg(
        F.lit(name).alias("bucket_name"), found.alias("document")
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One document per line, sorted by name across the files."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)
