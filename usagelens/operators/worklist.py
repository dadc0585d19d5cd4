"""What to collect next: inventory against current rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.functions.times import is_stale
from usagelens.operators.summary import STALE_SECONDS

# Fixed value: more entities than this to update means a full refresh.
BULK_THRESHOLD = 500


def uncollected(
    inv: DataFrame, cur: DataFrame, limit: int | None = 100, order: list[str] | None = None
) -> DataFrame:
    """Inventory names without a current row, in list order; repeated names stay repeated."""
    order = order or ["pos"]
    missing = inv.join(cur.select("bucket_name"), "bucket_name", "left_anti").orderBy(
        *order, "bucket_name"
    )
    return (missing if limit is None else missing.limit(limit)).select("bucket_name")


def _stale(cur: DataFrame, as_of: datetime, threshold_seconds: int) -> DataFrame:
    limit = timedelta(seconds=threshold_seconds)
    return cur.filter(is_stale(F.col("collected_at"), as_of, limit)).select(
        "bucket_name", "collected_at"
    )


def refresh_worklist(
    inv: DataFrame,
    cur: DataFrame,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    limit: int | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Distinct names to collect: uncollected in list order, then stale, oldest first.

    A name is either in ``cur`` or not, so the two parts are disjoint and only repeated
    inventory names need to be reduced; that happens before the anti join.
    """
    order = order or ["pos"]
    listed = inv.groupBy("bucket_name").agg(F.min(F.struct(*order)).alias("place"))
    new = listed.join(cur.select("bucket_name"), "bucket_name", "left_anti").select(
        "bucket_name",
        F.lit("uncollected").alias("reason"),
        "place",
        F.lit(None).cast("timestamp_ntz").alias("collected_at"),
    )
    old = _stale(cur, as_of, threshold_seconds).select(
        "bucket_name", F.lit("stale").alias("reason"), "collected_at"
    )
    both = new.unionByName(old, allowMissingColumns=True).orderBy(
        F.desc("reason"), "place", F.asc_nulls_first("collected_at"), "bucket_name"
    )
    return (both if limit is None else both.limit(limit)).select("bucket_name", "reason")


def refresh_worklist_prioritised(
    inv: DataFrame,
    cur: DataFrame,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    limit: int = 100,
    order: list[str] | None = None,
) -> DataFrame:
    """Up to ``limit`` names: uncollected first as listed, the rest filled with stale ones."""
    order = order or ["pos"]
    new = inv.join(cur.select("bucket_name"), "bucket_name", "left_anti").select(
        "bucket_name",
        F.lit(0).alias("priority"),
        F.struct(*order).alias("place"),
        F.lit(None).cast("timestamp_ntz").alias("collected_at"),
    )
    old = _stale(cur, as_of, threshold_seconds).withColumn("priority", F.lit(1))
    return (
        new.unionByName(old, allowMissingColumns=True)
        .orderBy("priority", "place", F.asc_nulls_first("collected_at"), "bucket_name")
        .limit(limit)
        .select("bucket_name", "priority")
    )


def refresh_plan(
    inv: DataFrame,
    cur: DataFrame,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    bulk_threshold: int = BULK_THRESHOLD,
) -> DataFrame:
    """One row: how much there is to update and whether to refresh everything.

    One full outer join of unique names gives every count. ``orphans`` are current rows
    the inventory no longer lists.
    """
    listed = inv.groupBy("bucket_name").agg(F.count(F.lit(1)).alias("times"))
    known = cur.select("bucket_name", "collected_at", F.lit(True).alias("known"))
    both = listed.join(known, "bucket_name", "full_outer")
    is_known = F.coalesce("known", F.lit(False))
    limit = timedelta(seconds=threshold_seconds)

    def listings(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("times"))), F.lit(0).cast("bigint"))

    counts = both.agg(
        listings(F.col("times").isNotNull()).alias("total_buckets"),
        F.count_if(is_known).alias("in_db"),
        listings(~is_known).alias("uncollected"),
        F.count_if(is_known & is_stale(F.col("collected_at"), as_of, limit)).alias("stale"),
        F.count_if(is_known & F.col("times").isNull()).alias("orphans"),
    ).withColumn("to_update", F.col("uncollected") + F.col("stale"))
    mode = (
        F.when(F.col("to_update") == 0, "none")
        .when(F.col("to_update") > bulk_threshold, "bulk")
        .otherwise("per-bucket")
    )
    return counts.select(
        "total_buckets", "in_db", "uncollected", "stale", "to_update", "orphans", mode.alias("mode")
    )
