"""Table schemas, documented document shape, and typed defaults."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


# Measures of one storage class inside a document.
USAGE = _struct(
    size=_L,
    size_actual=_L,
    size_utilized=_L,
    size_kb=_L,
    size_kb_actual=_L,
    size_kb_utilized=_L,
    num_objects=_L,
)
QUOTA = _struct(enabled=_B, check_on_raw=_B, max_size=_L, max_size_kb=_L, max_objects=_L)
PLACEMENT = _struct(data_pool=_S, data_extra_pool=_S, index_pool=_S)

# Column that receives the text of a document which does not fit RAW.
CORRUPT = "_bad"

# The document as it lands.
RAW = _struct(
    bucket=_S,
    num_shards=_I,
    tenant=_S,
    versioning=_S,
    zonegroup=_S,
    placement_rule=_S,
    explicit_placement=PLACEMENT,
    id=_S,
    marker=_S,
    index_type=_S,
    versioned=_B,
    versioning_enabled=_B,
    object_lock_enabled=_B,
    mfa_enabled=_B,
    owner=_S,
    ver=_S,
    master_ver=_S,
    mtime=_S,
    creation_time=_S,
    max_marker=_S,
    usage=T.MapType(_S, USAGE),
    bucket_quota=QUOTA,
)

# Latest row per entity.
CURRENT = _struct(
    bucket_name=_S,
    bucket_id=_S,
    marker=_S,
    tenant=_S,
    owner=_S,
    zonegroup=_S,
    placement_rule=_S,
    explicit_placement=PLACEMENT,
    num_shards=_I,
    index_type=_S,
    versioning=_S,
    versioned=_B,
    versioning_enabled=_B,
    object_lock_enabled=_B,
    mfa_enabled=_B,
    ver=_S,
    master_ver=_S,
    max_marker=_S,
    mtime=_S,
    creation_time=_S,
    size_bytes=_L,
    size_actual_bytes=_L,
    size_utilized_bytes=_L,
    num_objects=_L,
    usage=T.MapType(_S, USAGE),
    bucket_quota=QUOTA,
    sync_status=_S,
    sync_behind_shards=_L,
    sync_behind_entries=_L,
    sync_source_zone=_S,
    collected_at=_TS,
    collection_duration_ms=_I,
)

# Append-only time series. The id is a long: a 32-bit sequence would overflow.
HISTORY = _struct(
    id=_L,
    bucket_name=_S,
    size_bytes=_L,
    num_objects=_L,
    sync_behind_shards=_L,
    sync_behind_entries=_L,
    collected_at=_TS,
)

# Latest row per (entity, storage class).
CLASS_USAGE = _struct(
    bucket_name=_S,
    storage_class=_S,
    size_bytes=_L,
    size_actual_bytes=_L,
    size_utilized_bytes=_L,
    num_objects=_L,
    collected_at=_TS,
)

# Latest replication status per entity.
READING = _struct(
    bucket_name=_S,
    sync_status=_S,
    sync_behind_shards=_L,
    sync_behind_entries=_L,
    sync_source_zone=_S,
    collected_at=_TS,
)

SYNC_COLUMNS = ["sync_status", "sync_behind_shards", "sync_behind_entries", "sync_source_zone"]

# Text defaults of the document format.
TEXT_DEFAULTS = {"index_type": "Normal", "versioning": "off"}
QUOTA_DEFAULT = {
    "enabled": False,
    "check_on_raw": False,
    "max_size": -1,
    "max_size_kb": 0,
    "max_objects": -1,
}
PLACEMENT_DEFAULT = {"data_pool": "", "data_extra_pool": "", "index_pool": ""}

# Record columns that tables written by earlier releases may lack.
ADDED_LATER = (
    "marker",
    "explicit_placement",
    "index_type",
    "versioning",
    "versioned",
    "versioning_enabled",
    "object_lock_enabled",
    "mfa_enabled",
    "ver",
    "master_ver",
    "max_marker",
    "mtime",
    "creation_time",
    "size_utilized_bytes",
    "usage",
    "bucket_quota",
)
