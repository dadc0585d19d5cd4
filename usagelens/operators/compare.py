"""Now against then: totals, per entity, per entity within a window."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.measures import BIGINT, pct_change, total
from usagelens.functions.times import since
from usagelens.operators.growth import first_last_per_entity


def compare_snapshots(
    cur: DataFrame,
    hist: DataFrame,
    as_of: datetime,
    hours_ago: int = 24,
    total_type: str = BIGINT,
) -> DataFrame:
    """Current totals against the hour that ended ``hours_ago`` hours ago, in one row.

    Both sides are one-row aggregates; they are added up after a union, so there is no join.
    """
    end = as_of - timedelta(hours=hours_ago)
    names = ["size_bytes", "objects", "buckets"]

    def side(df: DataFrame, buckets, prefix: str, other: str) -> DataFrame:
        totals = df.agg(
            total("size_bytes", total_type).alias(f"{prefix}_size_bytes"),
            total("num_objects", total_type).alias(f"{prefix}_objects"),
            buckets.alias(f"{prefix}_buckets"),
        )
        zeros = {f"{other}_{n}": F.lit(0).cast("bigint") for n in names}
        return totals.withColumns(zeros)

    past = since(hist, end - timedelta(hours=1), end)
    both = side(cur, F.count(F.lit(1)), "current", "historical").unionByName(
        side(past, F.countDistinct("bucket_name"), "historical", "current")
    )
    columns = [f"{prefix}_{n}" for prefix in ("current", "historical") for n in names]
    types = {c: BIGINT if c.endswith("_buckets") else total_type for c in columns}
    row = both.agg(*[F.sum(c).cast(types[c]).alias(c) for c in columns])

    def delta(name: str):
        return F.col(f"current_{name}") - F.col(f"historical_{name}")

    return row.select(
        *columns,
        delta("size_bytes").cast(total_type).alias("delta_size_bytes"),
        delta("objects").cast(total_type).alias("delta_objects"),
        F.lit(hours_ago).alias("period_hours"),
    )


def entity_changes(
    hist: DataFrame,
    cur: DataFrame,
    as_of: datetime,
    hours: int = 24,
    min_change_pct: float = 10.0,
) -> DataFrame:
    """Entities whose size changed by a minimum percentage within some hours."""
    window = since(hist, as_of - timedelta(hours=hours))
    ends = first_last_per_entity(window, ["size_bytes"]).filter("snapshots >= 2")
    old, new = F.col("old_size"), F.col("new_size")
    changes = ends.select(
        "bucket_name",
        F.col("first_size_bytes").alias("old_size"),
        F.col("last_size_bytes").alias("new_size"),
    ).withColumn("change_pct", pct_change(new, old))
    # the filter needs nothing from the other side, so it runs before the join
    large = changes.filter(F.abs("change_pct") >= float(min_change_pct))
    return (
        large.join(cur.select("bucket_name", "owner"), "bucket_name")
        .select("bucket_name", "owner", "old_size", "new_size", (new - old).alias("delta"), "change_pct")
        .orderBy(F.desc(F.abs("delta")), "bucket_name")
    )


def entity_comparison(
    cur: DataFrame, hist: DataFrame, as_of: datetime, days: int = 7, limit: int = 50
) -> DataFrame:
    """Each entity now against its first snapshot in the one-day window ``days`` ago.

    Entities without a snapshot in that window count as unchanged.
    """
    start = as_of - timedelta(days=days)
    past = first_last_per_entity(
        since(hist, start, start + timedelta(days=1)), ["size_bytes", "num_objects"], ("first",)
    ).select(
        "bucket_name",
        F.col("first_size_bytes").alias("past_size"),
        F.col("first_num_objects").alias("past_objects"),
        F.col("first_collected_at").alias("old_time"),
    )
    now = cur.select(
        "bucket_name",
        "owner",
        F.col("size_bytes").alias("current_size"),
        F.col("num_objects").alias("current_objects"),
        F.col("collected_at").alias("current_time"),
    )
    past_size, size = F.col("past_size"), F.col("current_size")
    return (
        now.join(past, "bucket_name", "left")
        .withColumns(
            {
                "old_size": F.coalesce("past_size", "current_size"),
                "old_objects": F.coalesce("past_objects", "current_objects"),
                "size_pct_change": pct_change(size, past_size),
            }
        )
        .select(
            "bucket_name",
            "owner",
            "current_size",
            "current_objects",
            "old_size",
            "old_objects",
            (size - F.col("old_size")).alias("size_delta"),
            (F.col("current_objects") - F.col("old_objects")).alias("obj_delta"),
            "size_pct_change",
            "current_time",
            "old_time",
        )
        .orderBy(F.desc(F.abs("size_delta")), "bucket_name")
        .limit(limit)
    )
