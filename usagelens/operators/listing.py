"""Point lookups, top-k and ordered listings."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.times import age_seconds, is_stale, ntz, since


def entity_row(cur: DataFrame, name: str) -> DataFrame:
    """All columns of one entity."""
    return cur.filter(F.col("bucket_name") == name)


def entity_details(cur: DataFrame, name: str) -> DataFrame:
    """Detail columns of one entity, with the names of its storage classes."""
    return entity_row(cur, name).select(
        "bucket_name",
        "bucket_id",
        "tenant",
        "owner",
        "zonegroup",
        "placement_rule",
        "num_shards",
        "size_bytes",
        "size_actual_bytes",
        "num_objects",
        F.array_sort(F.map_keys("usage")).alias("storage_classes"),
        "sync_status",
        "sync_behind_shards",
        "collected_at",
    )


def entity_history(hist: DataFrame, name: str, as_of: datetime, days: int = 30) -> DataFrame:
    """The series of one entity over the last days, in time order."""
    window = since(hist.filter(F.col("bucket_name") == name), as_of - timedelta(days=days))
    tie = ["id"] if "id" in hist.columns else []
    return window.orderBy("collected_at", *tie).select("collected_at", "size_bytes", "num_objects")


def entity_history_last(
    hist: DataFrame, name: str, as_of: datetime, days: int = 30, last: int = 20
) -> DataFrame:
    """The newest ``last`` rows of the series, newest first."""
    window = since(hist.filter(F.col("bucket_name") == name), as_of - timedelta(days=days))
    tie = ["id"] if "id" in hist.columns else []
    return (
        window.orderBy(F.desc("collected_at"), *[F.desc(c) for c in tie])
        .limit(last)
        .select("collected_at", "size_bytes", "num_objects")
    )


def top_by_size(cur: DataFrame, limit: int = 20) -> DataFrame:
    return (
        cur.select("bucket_name", "owner", "num_objects", "size_bytes", "collected_at")
        .orderBy(F.desc("size_bytes"), "bucket_name")
        .limit(limit)
    )


def top_by_objects(cur: DataFrame, limit: int = 20) -> DataFrame:
    return (
        cur.select("bucket_name", "owner", "num_objects", "size_bytes")
        .orderBy(F.desc("num_objects"), "bucket_name")
        .limit(limit)
    )


def _orderings() -> dict[str, Column]:
    return {
        "size": F.desc("size_bytes"),
        "objects": F.desc("num_objects"),
        "age": F.asc_nulls_last("collected_at"),
        "name": F.asc("bucket_name"),
    }


def listing(
    cur: DataFrame, as_of: datetime, sort_by: str = "size", limit: int = 100
) -> DataFrame:
    """Entities in a chosen order with their age; an unknown order means by size."""
    orderings = _orderings()
    return (
        cur.select(
            "bucket_name",
            "owner",
            "num_objects",
            "size_bytes",
            "sync_status",
            F.col("sync_behind_shards").alias("shards_behind"),
            "collected_at",
            age_seconds(F.col("collected_at"), as_of).alias("age_seconds"),
        )
        .orderBy(orderings.get(sort_by, orderings["size"]), "bucket_name")
        .limit(limit)
    )


def all_entities(cur: DataFrame) -> DataFrame:
    """Every entity by name; a range-partitioned sort."""
    return cur.select(
        "bucket_name", "owner", "size_bytes", "num_objects", "collected_at", "num_shards"
    ).orderBy("bucket_name")


def empty_entities(cur: DataFrame) -> DataFrame:
    """Entities that hold no object."""
    return (
        cur.filter(F.col("num_objects") == 0)
        .select("bucket_name", "owner", "num_objects", "size_bytes", "collected_at")
        .orderBy("bucket_name")
    )


def stale_for_refresh(
    cur: DataFrame, as_of: datetime, threshold_seconds: int, limit: int | None = 100
) -> DataFrame:
    """Names to collect again: never timed or too old, oldest first."""
    stale = (
        cur.filter(
            is_stale(F.col("collected_at"), as_of, timedelta(seconds=threshold_seconds))
        )
        .select("bucket_name", "collected_at")
        .orderBy(F.asc_nulls_first("collected_at"), "bucket_name")
    )
    return (stale if limit is None else stale.limit(limit)).select("bucket_name")


def stale_report(
    cur: DataFrame, as_of: datetime, minutes: int = 10, limit: int = 100
) -> DataFrame:
    """Rows older than some minutes, oldest first; rows without a time are not listed."""
    return (
        cur.filter(F.col("collected_at") < ntz(as_of - timedelta(minutes=minutes)))
        .select("bucket_name", "owner", "collected_at")
        .orderBy("collected_at", "bucket_name")
        .limit(limit)
    )
