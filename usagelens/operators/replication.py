"""Replication lag: per status, lagging entities, now against the last day."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.measures import BIGINT, total
from usagelens.functions.times import since


def with_status(cur: DataFrame) -> DataFrame:
    """Entities whose replication status is known."""
    return cur.filter(F.col("sync_status").isNotNull() & (F.col("sync_status") != ""))


def sync_status_summary(cur: DataFrame, total_type: str = BIGINT) -> DataFrame:
    """Entities and lagging shards per status, most frequent first."""
    return (
        with_status(cur)
        .groupBy("sync_status")
        .agg(
            F.count(F.lit(1)).alias("bucket_count"),
            total("sync_behind_shards", total_type).alias("shards_behind"),
        )
        .orderBy(F.desc("bucket_count"), "sync_status")
    )


def lagging_by_shards(cur: DataFrame, limit: int = 50) -> DataFrame:
    return (
        cur.filter(F.col("sync_behind_shards") > 0)
        .select(
            "bucket_name",
            "owner",
            "sync_status",
            F.col("sync_behind_shards").alias("shards_behind"),
            "size_bytes",
        )
        .orderBy(F.desc("shards_behind"), "bucket_name")
        .limit(limit)
    )


def lagging_by_entries(cur: DataFrame, limit: int = 50) -> DataFrame:
    return (
        cur.filter((F.col("sync_behind_shards") > 0) | (F.col("sync_behind_entries") > 0))
        .select(
            "bucket_name",
            "owner",
            "sync_status",
            F.col("sync_behind_shards").alias("shards_behind"),
            F.col("sync_behind_entries").alias("entries_behind"),
        )
        .orderBy(F.desc("entries_behind"), "bucket_name")
        .limit(limit)
    )


def sync_comparison(
    cur: DataFrame, hist: DataFrame, as_of: datetime, limit: int = 50
) -> DataFrame:
    """Lag now against average and maximum over the last 24 hours, worst first."""
    recent = (
        since(hist, as_of - timedelta(hours=24))
        .groupBy("bucket_name")
        .agg(
            F.avg("sync_behind_shards").alias("avg_shards"),
            F.max("sync_behind_shards").alias("max_shards"),
        )
    )
    now = with_status(cur).select(
        "bucket_name",
        "owner",
        "sync_status",
        F.col("sync_behind_shards").alias("shards_behind"),
        F.col("sync_behind_entries").alias("entries_behind"),
        "size_bytes",
        "collected_at",
    )
    return (
        now.join(recent, "bucket_name", "left")
        .select(
            "bucket_name",
            "owner",
            "sync_status",
            "shards_behind",
            "entries_behind",
            "size_bytes",
            F.coalesce("avg_shards", F.lit(0.0)).alias("avg_shards_24h"),
            F.coalesce("max_shards", F.lit(0)).alias("max_shards_24h"),
            "collected_at",
        )
        .orderBy(F.desc("shards_behind"), "bucket_name")
        .limit(limit)
    )
