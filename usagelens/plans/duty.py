"""What to collect next, published after every cycle for the collector.

The work list and the plan are written as the next version of a folder; a reader sees the newest
complete one. The list keeps its order in ``place``, so any part of it can be handed out.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.summary import STALE_SECONDS
from usagelens.operators.worklist import BULK_THRESHOLD, refresh_plan, refresh_worklist
from usagelens.sinks import versions

_PLAN = (
    "total_buckets bigint, in_db bigint, uncollected bigint, stale bigint, to_update bigint, orphans bigint, "
    "mode string, as_of timestamp_ntz"
)
_LIST = "place bigint, bucket_name string, reason string"


def publish_duty(
    inv: DataFrame,
    cur: DataFrame,
    root: str,
    version: int,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    bulk_threshold: int = BULK_THRESHOLD,
    keep: int = 10,
) -> None:
    """Write the work list and the plan as of a moment; publishing a version again replaces it."""
    spark = cur.sparkSession
    # sorted over the partitions, so ids rise along the list
    listed = refresh_worklist(inv, cur, as_of, threshold_seconds)
    placed = listed.select(F.monotonically_increasing_id().alias("place"), "bucket_name", "reason")
    placed.write.mode("overwrite").parquet(versions.data_path(root, version))
    plan = refresh_plan(inv, cur, as_of, threshold_seconds, bulk_threshold)
    stamp = F.lit(as_of.isoformat(" ")).cast("timestamp_ntz").alias("as_of")
    versions.commit(plan.select("*", stamp), root, version)
    versions.drop_old(spark, root, keep)


def read_worklist(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """``bucket_name, reason`` of the newest list, in its order; empty before the first cycle."""
    version = versions.latest_version(spark, root)
    if version is None:
        rows = spark.createDataFrame([], _LIST)
    else:
        rows = spark.read.schema(_LIST).parquet(versions.data_path(root, version))
    rows = rows.orderBy("place")
    return (rows if limit is None else rows.limit(limit)).select("bucket_name", "reason")


def read_plan(spark: SparkSession, root: str) -> DataFrame:
    """The newest plan, one row; empty before the first cycle."""
    version = versions.latest_version(spark, root)
    if version is None:
        return spark.createDataFrame([], _PLAN)
    return versions.read_commit(spark, root, version, _PLAN)
