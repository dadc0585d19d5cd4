"""The serving snapshot: pre-computed sections for viewers."""

from __future__ import annotations

from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from usagelens.functions.times import age_seconds, iso_text, ntz
from usagelens.operators.replication import lagging_by_entries, with_status
from usagelens.operators.summary import cluster_summary, freshness_bands, summary_by_owner
from usagelens.schemas import ADDED_LATER, CURRENT
from usagelens.sinks import versions
from usagelens.sinks.keyed import KeyedTable

# Rows per section.
TOP = 100
OWNERS = 50
BEHIND = 50

UPDATED = "_cache_updated"

# Columns of each section when it is read back.
SECTIONS = {
    "summary": "total_buckets bigint, total_owners bigint, total_size_bytes bigint, "
    "total_objects bigint, oldest_collection string, newest_collection string",
    "top_by_size": "bucket_name string, owner string, size_bytes bigint, "
    "size_actual_bytes bigint, num_objects bigint, num_shards int, collected_at string",
    "top_by_objects": "bucket_name string, owner string, size_bytes bigint, "
    "num_objects bigint, collected_at string",
    "freshness": "freshness string, count bigint",
    "by_owner": "owner string, bucket_count bigint, total_size bigint, total_objects bigint",
    "all_buckets": "bucket_name string, owner string, size_bytes bigint, num_objects bigint, "
    "collected_at string, num_shards int",
    "sync_summary": "sync_status string, count bigint",
    "sync_behind": "bucket_name string, owner string, sync_status string, "
    "shards_behind bigint, entries_behind bigint",
}

_NEEDED = [
    "bucket_name",
    "owner",
    "size_bytes",
    "size_actual_bytes",
    "num_objects",
    "num_shards",
    "collected_at",
    "sync_status",
    "sync_behind_shards",
    "sync_behind_entries",
]

# Place of ``all_buckets`` among the sections.
_ROWS_AT = list(SECTIONS).index("all_buckets")
_STAMP = "updated timestamp_ntz, newest timestamp_ntz, table string, shards int, table_version bigint"


def _text(name: str) -> Column:
    return iso_text(F.col(name), " ").alias(name)


def _section(name: str, rows: DataFrame, order: list[Column] | None) -> DataFrame:
    """``section, rank, json``. Only sections of bounded size are ranked, others have rank 0."""
    json = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json")
    rank = F.lit(0) if order is None else F.row_number().over(Window.orderBy(*order))
    return rows.select(F.lit(name).alias("section"), rank.alias("rank"), json)


def serving_snapshot(cur: DataFrame, as_of: datetime, rows: bool = True) -> DataFrame:
    """All sections in long form, ``all_buckets`` only with ``rows``.

    Ranked sections hold at most ``TOP`` rows or one row per status or band, so ranking them
    in one task is safe. ``all_buckets`` grows with the table and is not ranked: its order
    is that of the name each row carries.
    """
    name = F.asc("bucket_name")
    by_size, by_objects = F.desc("size_bytes"), F.desc("num_objects")
    top = ["bucket_name", "owner", "size_bytes"]
    parts = [
        _section(
            "summary",
            cluster_summary(cur, "oldest_collection", "newest_collection").select(
                "total_buckets",
                "total_owners",
                "total_size_bytes",
                "total_objects",
                _text("oldest_collection"),
                _text("newest_collection"),
            ),
            [F.asc("total_buckets")],
        ),
        _section(
            "top_by_size",
            cur.orderBy(by_size, name)
            .limit(TOP)
            .select(*top, "size_actual_bytes", "num_objects", "num_shards", _text("collected_at")),
            [by_size, name],
        ),
        _section(
            "top_by_objects",
            cur.orderBy(by_objects, name)
            .limit(TOP)
            .select(*top, "num_objects", _text("collected_at")),
            [by_objects, name],
        ),
        _section("freshness", freshness_bands(cur, as_of), [F.asc("freshness")]),
        _section(
            "by_owner",
            summary_by_owner(cur, OWNERS).select(
                "owner", "bucket_count", "total_size", "total_objects"
            ),
            [F.desc("total_size"), F.asc("owner")],
        ),
        _section(
            "all_buckets",
            # rows go to files, the reader sorts: no global sort here
            cur.select(
                *top, "num_objects", _text("collected_at"), "num_shards"
            ),
            None,
        ),
        _section(
            "sync_summary",
            with_status(cur).groupBy("sync_status").agg(F.count(F.lit(1)).alias("count")),
            [F.asc("sync_status")],
        ),
        _section(
            "sync_behind",
            lagging_by_entries(cur, BEHIND),
            [F.desc("entries_behind"), name],
        ),
    ]
    if not rows:
        del parts[_ROWS_AT]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def publish_serving(
    cur: DataFrame,
    root: str,
    version: int,
    as_of: datetime,
    keep: int = 3,
    table: KeyedTable | None = None,
    table_version: int = 0,
) -> None:
    """Write the snapshot as a new version; readers switch when it is complete.

    The newest ``keep`` versions stay, so a reader of the one before is not disturbed. If ``cur``
    is a version of a ``table``, its rows are not written once more: the snapshot names the version, and
    ``all_buckets`` is read there, as long as the table keeps it. What is written then does not
    grow with the table.
    """
    spark = cur.sparkSession
    rows = cur.select(*_NEEDED).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        target = versions.data_path(root, version)
        (
            serving_snapshot(rows, as_of, rows=table is None)
            .write.mode("overwrite")
            .partitionBy("section")
            .parquet(target)
        )
        place = (table.root, table.shards, table_version) if table else (None, None, None)
        stamp = rows.agg(F.max("collected_at").alias("newest")).select(
            ntz(as_of).alias("updated"),
            "newest",
            F.lit(place[0]).cast("string").alias("table"),
            F.lit(place[1]).cast("int").alias("shards"),
            F.lit(place[2]).cast("bigint").alias("table_version"),
        )
        versions.commit(stamp, root, version)
        versions.drop_old(spark, root, keep)
    finally:
        rows.unpersist()


def _rows_of_table(spark: SparkSession, root: str, version: int) -> DataFrame | None:
    """``all_buckets`` from the table version that a snapshot names; None if it has its own rows."""
    stamp = versions.read_commit(spark, root, version, _STAMP).first()
    if stamp["table"] is None:
        return None
    table = KeyedTable(stamp["table"], CURRENT, ("bucket_name",), (), stamp["shards"], ADDED_LATER)
    rows = table.read(spark, stamp["table_version"])
    columns = [_text(c) if c == "collected_at" else F.col(c) for c in _fields("all_buckets")]
    return rows.select(*columns).orderBy("bucket_name")


def _fields(section: str) -> list[str]:
    return [field.split()[0] for field in SECTIONS[section].split(", ")]


def read_section(
    spark: SparkSession, root: str, section: str, limit: int | None = None
) -> DataFrame | None:
    """A section of the newest snapshot, in order; None when nothing is published."""
    version = versions.latest_version(spark, root)
    if version is None:
        return None
    if section == UPDATED:
        return versions.read_commit(spark, root, version, "updated timestamp_ntz")
    if section == "all_buckets":
        whole = _rows_of_table(spark, root, version)
        if whole is not None:
            return whole if limit is None else whole.limit(limit)
    rows = (
        spark.read.schema("rank int, json string, section string")
        .parquet(versions.data_path(root, version))
        .filter(F.col("section") == section)
        .select("rank", F.from_json("json", SECTIONS[section]).alias("row"))
        .select("rank", "row.*")
    )
    ordered = rows.orderBy("rank", *(["bucket_name"] if section == "all_buckets" else []))
    return (ordered if limit is None else ordered.limit(limit)).drop("rank")


def serving_age(spark: SparkSession, root: str, as_of: datetime) -> DataFrame | None:
    """Age in seconds of the newest snapshot, and of the newest row of the table it shows."""
    version = versions.latest_version(spark, root)
    if version is None:
        return None
    stamp = versions.read_commit(spark, root, version, "updated timestamp_ntz, newest timestamp_ntz")
    return stamp.select(
        "updated",
        age_seconds(F.col("updated"), as_of).alias("age_seconds"),
        "newest",
        age_seconds(F.col("newest"), as_of).alias("data_age_seconds"),
    )
