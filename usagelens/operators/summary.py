"""Summaries: whole cluster, owners, storage classes, freshness, staleness."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.measures import BIGINT, share_pct, total
from usagelens.functions.times import is_stale, ntz

# Thresholds of the status report in seconds, and its default threshold.
LADDER = [60, 300, 600, 3600]
STALE_SECONDS = 1800

# Freshness limits.
FRESH_LIMITS = {
    "fresh_5m": timedelta(minutes=5),
    "fresh_10m": timedelta(minutes=10),
    "fresh_1h": timedelta(hours=1),
}
BANDS = {
    "fresh_10m": timedelta(minutes=10),
    "fresh_1h": timedelta(hours=1),
    "fresh_24h": timedelta(hours=24),
}


def _summary_columns(oldest: str, newest: str, total_type: str) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_buckets"),
        F.countDistinct("owner").alias("total_owners"),
        total("num_objects", total_type).alias("total_objects"),
        total("size_bytes", total_type).alias("total_size_bytes"),
        F.min("collected_at").alias(oldest),
        F.max("collected_at").alias(newest),
    ]


def cluster_summary(
    cur: DataFrame,
    oldest: str = "oldest_data",
    newest: str = "newest_data",
    total_type: str = BIGINT,
) -> DataFrame:
    """One row for the whole cluster; owners are counted exactly."""
    return cur.agg(*_summary_columns(oldest, newest, total_type))


def summary_by_owner(cur: DataFrame, limit: int | None = 50, total_type: str = BIGINT) -> DataFrame:
    """Per owner, largest first. Entities without an owner form a group."""
    owners = cur.groupBy("owner").agg(
        F.count(F.lit(1)).alias("bucket_count"),
        total("num_objects", total_type).alias("total_objects"),
        total("size_bytes", total_type).alias("total_size"),
    )
    ranked = owners.orderBy(F.desc("total_size"), "owner")
    return ranked if limit is None else ranked.limit(limit)


def storage_class_distribution(
    usage: DataFrame, total_type: str = BIGINT, unique: bool = False
) -> DataFrame:
    """Per storage class: distinct entities and totals, largest first.

    ``unique`` says that there is one row per (entity, class), as in the keyed table. Then
    rows are counted, which saves the shuffle by (class, entity) a distinct count needs.
    """
    entities = F.count("bucket_name") if unique else F.countDistinct("bucket_name")
    return (
        usage.groupBy("storage_class")
        .agg(
            entities.alias("bucket_count"),
            total("num_objects", total_type).alias("total_objects"),
            total("size_bytes", total_type).alias("total_size"),
        )
        .orderBy(F.desc("total_size"), "storage_class")
    )


def collection_freshness(cur: DataFrame, as_of: datetime) -> DataFrame:
    """Cumulative counts and shares of rows at most 5 minutes, 10 minutes, 1 hour old."""
    counts = cur.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("collected_at") >= ntz(as_of - limit)).alias(name)
            for name, limit in FRESH_LIMITS.items()
        ],
        F.min("collected_at").alias("oldest"),
        F.max("collected_at").alias("newest"),
    )
    pairs = [
        column
        for name in FRESH_LIMITS
        for column in (F.col(name), share_pct(F.col(name), F.col("total")).alias(f"{name}_pct"))
    ]
    return counts.select("total", *pairs, "oldest", "newest")


def freshness_bands(cur: DataFrame, as_of: datetime) -> DataFrame:
    """Rows per exclusive age band; rows without a time are stale; empty bands are absent."""
    bands = [
        F.when(F.col("collected_at") >= ntz(as_of - limit), name) for name, limit in BANDS.items()
    ]
    band = F.coalesce(*bands, F.lit("stale")).alias("freshness")
    return cur.groupBy(band).agg(F.count(F.lit(1)).alias("count"))


def stale_count(cur: DataFrame, as_of: datetime, threshold_seconds: int = STALE_SECONDS) -> DataFrame:
    limit = timedelta(seconds=threshold_seconds)
    return cur.agg(
        F.lit(threshold_seconds).alias("threshold_seconds"),
        F.count_if(is_stale(F.col("collected_at"), as_of, limit)).alias("stale_count"),
    )


def stale_ladder(
    cur: DataFrame, as_of: datetime, thresholds: list[int] | None = None
) -> DataFrame:
    """Stale rows per threshold; all thresholds in one pass."""
    thresholds = thresholds or LADDER
    counts = cur.agg(
        *[
            F.count_if(is_stale(F.col("collected_at"), as_of, timedelta(seconds=t))).alias(f"n{t}")
            for t in thresholds
        ]
    )

    def label(seconds: int) -> str:
        return f"{seconds // 60}m" if seconds < 3600 else f"{seconds // 3600}h"

    steps = [
        F.struct(
            F.lit(t).alias("threshold_seconds"),
            F.lit(label(t)).alias("label"),
            F.col(f"n{t}").alias("stale_count"),
        )
        for t in thresholds
    ]
    return counts.select(F.inline(F.array(*steps)))


def timestamp_health(cur: DataFrame) -> DataFrame:
    return cur.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("collected_at").isNull()).alias("null_collected_at"),
        F.min("collected_at").alias("oldest"),
        F.max("collected_at").alias("newest"),
    )


def status_rollup(
    cur: DataFrame,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    total_type: str = BIGINT,
) -> DataFrame:
    """Summary, time health and stale counts in one row and one pass."""

    def stale(seconds: int) -> Column:
        return F.count_if(is_stale(F.col("collected_at"), as_of, timedelta(seconds=seconds)))

    return cur.agg(
        *_summary_columns("oldest_collection", "newest_collection", total_type),
        F.count_if(F.col("collected_at").isNull()).alias("null_collected_at"),
        stale(threshold_seconds).alias("stale_buckets"),
        *[stale(t).alias(f"stale_{t}s") for t in LADDER],
    )
