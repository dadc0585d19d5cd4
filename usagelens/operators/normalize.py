"""Typed documents -> records, and records -> documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.documents import (
    placement_document,
    quota_document,
    usage_document,
    usage_total,
)
from usagelens.functions.measures import falsy
from usagelens.functions.times import iso_text, ntz
from usagelens.schemas import CLASS_USAGE, CURRENT, HISTORY, RAW, SYNC_COLUMNS, TEXT_DEFAULTS

# Record column -> document key, where the two differ.
_RENAMED = {"bucket_name": "bucket", "bucket_id": "id"}
_TOTALS = {
    "size_bytes": "size",
    "size_actual_bytes": "size_actual",
    "size_utilized_bytes": "size_utilized",
    "num_objects": "num_objects",
}


def normalize(documents: DataFrame, as_of: datetime | None = None, extra: list[str] | None = None) -> DataFrame:
    """Documents with the columns of ``RAW`` -> records with the columns of ``CURRENT``.

    ``collected_at`` is taken from the input or set to ``as_of``. The sync columns are
    NULL: a stats document says nothing about replication, and NULL lets a merge keep what
    is known. A key with an explicit JSON null is treated like a missing key.
    """
    given = set(documents.columns)
    def column(field: T.StructField) -> Column:
        name = field.name
        source = _RENAMED.get(name, name)
        if name in _TOTALS:
            value = F.coalesce(usage_total(F.col("usage"), _TOTALS[name]), F.lit(0))
        elif name == "collected_at":
            value = F.col(name) if name in given else ntz(as_of)
        elif name in SYNC_COLUMNS:
            value = F.col(name) if name in given else F.lit(None)
        elif name in ("collection_duration_ms", "num_shards"):
            value = F.coalesce(F.col(source) if source in given else F.lit(0), F.lit(0))
        elif isinstance(field.dataType, T.StringType):
            value = F.coalesce(F.col(source), F.lit(TEXT_DEFAULTS.get(name, "")))
        elif isinstance(field.dataType, T.BooleanType):
            value = F.coalesce(F.col(source), F.lit(False))
        elif name == "usage":
            value = F.coalesce(F.col("usage"), F.create_map().cast(field.dataType))
        else:
            value = F.col(source)
        return value.cast(field.dataType).alias(name)

    return documents.select(*[column(f) for f in CURRENT.fields], *(extra or []))


def with_defaults(records: DataFrame) -> DataFrame:
    """Records as a reader of one document sees them: no known status is an empty one, without lag.

    In the tables it stays NULL, which lets a merge keep what is known.
    """
    fill = {T.StringType: F.lit(""), T.LongType: F.lit(0).cast("bigint")}
    kinds = {f.name: type(f.dataType) for f in CURRENT.fields if f.name in SYNC_COLUMNS}
    return records.withColumns({n: F.coalesce(n, fill[kind]) for n, kind in kinds.items()})


def usage_rows(records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per (entity, storage class); missing measures count as 0."""
    rows = records.select(
        "bucket_name", "collected_at", *(extra or []), F.explode("usage").alias("storage_class", "u")
    )

    def measure(key: str, name: str) -> Column:
        return F.coalesce(F.col(f"u.{key}"), F.lit(0).cast("bigint")).alias(name)

    return rows.select(
        "bucket_name",
        "storage_class",
        *[measure(key, name) for name, key in _TOTALS.items()],
        "collected_at",
        *(extra or []),
    ).select(*CLASS_USAGE.names, *(extra or []))


def history_rows(records: DataFrame) -> DataFrame:
    """The history row of each record. The id depends on content and arrival only, so a retry
    repeats it, and two documents of one name and time have ids of their own.
    """
    place = [c for c in ("arrival",) if c in records.columns]
    parts = ["bucket_name", "collected_at", *place, "size_bytes", "num_objects"]
    identified = records.withColumn("id", F.xxhash64(*parts))
    lag = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in SYNC_COLUMNS[1:3]]
    return identified.select(
        *[c for c in HISTORY.names if c not in SYNC_COLUMNS and c != "collected_at"],
        *lag,
        "collected_at",
    ).select(*HISTORY.names)


def _document_fields() -> list[Column]:
    """The 22 keys of a document, in document order."""
    c = F.col
    special = {
        "bucket": c("bucket_name"),
        "num_shards": c("num_shards"),
        "id": falsy(c("bucket_id"), ""),
        "marker": falsy(falsy(c("marker"), c("bucket_id")), ""),
        "explicit_placement": placement_document(c("explicit_placement")),
        "usage": usage_document(c("usage")),
        "bucket_quota": quota_document(c("bucket_quota")),
    }
    columns = []
    for field in RAW.fields:
        if field.name in special:
            value = special[field.name]
        elif isinstance(field.dataType, T.BooleanType):
            value = F.coalesce(c(field.name), F.lit(False))
        else:
            value = falsy(c(field.name), TEXT_DEFAULTS.get(field.name, ""))
        columns.append(value.alias(field.name))
    return columns


def document_text(pretty: bool = False) -> Column:
    """The document of a record as JSON text."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    return F.to_json(F.struct(*_document_fields()), options)


def to_documents(records: DataFrame, pretty: bool = False) -> DataFrame:
    """Record -> ``bucket_name`` and its document as JSON text."""
    return records.select("bucket_name", document_text(pretty).alias("document"))


def to_internal_json(records: DataFrame) -> DataFrame:
    """Record -> ``bucket_name`` and all 32 columns as JSON text, times as ISO text."""
    special = {
        "usage": usage_document(F.col("usage")).alias("usage"),
        "collected_at": iso_text(F.col("collected_at")).alias("collected_at"),
    }
    columns = [special.get(name, F.col(name)) for name in CURRENT.names]
    record = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return records.select("bucket_name", record.alias("record"))
