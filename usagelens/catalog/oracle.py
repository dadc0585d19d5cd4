"""SQL for DuckDB that computes each registered query on the same tables.

Every statement starts with the same views over the driver's tables. Times, limits and
names are spelled out here again on purpose: the SQL shares nothing with the operators.
"""

from __future__ import annotations

_VIEWS = """
WITH hist AS (
  SELECT event_id AS id, user_id, concat('bucket-', user_id) AS bucket_name,
         CAST(floor(value * 1024) AS BIGINT) AS size_bytes,
         CAST(floor(value) AS BIGINT) AS num_objects,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS BIGINT) AS sync_behind_shards,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) * 10 AS BIGINT) AS sync_behind_entries,
         ts AS collected_at, event_type AS storage_class
  FROM events),
latest AS (
  SELECT * FROM hist
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY collected_at DESC, id DESC) = 1),
cur AS (
  SELECT l.user_id, l.bucket_name, concat('id-', l.user_id) AS bucket_id,
         CASE WHEN l.user_id % 2 = 0 THEN '' ELSE concat('id-', l.user_id) END AS marker,
         '' AS tenant, n.n_name AS owner, 'zg' AS zonegroup,
         'default-placement' AS placement_rule, CAST(NULL AS VARCHAR) AS explicit_placement,
         CAST(11 + l.user_id % 5 AS INTEGER) AS num_shards, 'Normal' AS index_type,
         CASE WHEN l.user_id % 5 <> 0 THEN 'off' END AS versioning,
         false AS versioned, false AS versioning_enabled, false AS object_lock_enabled,
         false AS mfa_enabled, '' AS ver, '' AS master_ver, '' AS max_marker, '' AS mtime,
         '' AS creation_time, l.size_bytes,
         CAST(ceil(l.size_bytes / 4096.0) * 4096 AS BIGINT) AS size_actual_bytes,
         l.size_bytes AS size_utilized_bytes, l.num_objects,
         CAST(NULL AS VARCHAR) AS bucket_quota,
         CASE WHEN l.user_id % 7 = 0 THEN '' WHEN l.user_id % 11 = 0 THEN NULL
              WHEN l.k > 0 THEN 'behind' ELSE 'synced' END AS sync_status,
         l.sync_behind_shards, l.sync_behind_entries, '' AS sync_source_zone,
         l.collected_at, CAST(0 AS INTEGER) AS collection_duration_ms
  FROM latest l JOIN customer c ON l.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
cur_nulls AS (
  SELECT * REPLACE (CASE WHEN user_id % 37 <> 0 THEN collected_at END AS collected_at) FROM cur),
cur_empty AS (
  SELECT * REPLACE (CASE WHEN user_id % 13 = 0 THEN 0 ELSE num_objects END AS num_objects) FROM cur),
usage AS (
  SELECT bucket_name, storage_class, size_bytes,
         CAST(ceil(size_bytes / 4096.0) * 4096 AS BIGINT) AS size_actual_bytes,
         size_bytes AS size_utilized_bytes, num_objects, collected_at
  FROM (SELECT * FROM hist
        QUALIFY row_number() OVER (PARTITION BY user_id, storage_class
                                   ORDER BY collected_at DESC, id DESC) = 1)),
usage_json AS (
  SELECT bucket_name, string_agg(storage_class, ',' ORDER BY storage_class) AS classes,
         CAST('{' || string_agg('"' || storage_class || '":' || json_object(
           'size', size_bytes, 'size_actual', size_actual_bytes,
           'size_utilized', size_utilized_bytes, 'num_objects', num_objects),
           ',' ORDER BY storage_class) || '}' AS JSON) AS usage,
         CAST(sum(size_bytes) AS BIGINT) AS total_size,
         CAST(sum(size_actual_bytes) AS BIGINT) AS total_size_actual,
         CAST(sum(size_utilized_bytes) AS BIGINT) AS total_size_utilized,
         CAST(sum(num_objects) AS BIGINT) AS total_num_objects
  FROM usage GROUP BY bucket_name),
inv AS (SELECT concat('bucket-', c_custkey) AS bucket_name, c_custkey AS pos FROM customer),
missing AS (SELECT * FROM inv WHERE bucket_name NOT IN (SELECT bucket_name FROM cur))
"""

_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_ARRIVALS = "TIMESTAMP '2024-01-16 00:00:00'"
_EMPTY_PLACEMENT = "json_object('data_pool', '', 'data_extra_pool', '', 'index_pool', '')"
_DEFAULT_QUOTA = (
    "json_object('enabled', false, 'check_on_raw', false, 'max_size', -1, "
    "'max_size_kb', 0, 'max_objects', -1)"
)

_SQL: dict[str, str] = {}


def _put(name: str, body: str) -> None:
    _SQL[name] = f"{_VIEWS}\n{body.strip()}"


def all_sql() -> dict[str, str]:
    return dict(_SQL)


def _bytes_label(x: str) -> str:
    """Bytes with one decimal; printf rounds the exact binary value half to even."""
    a = f"abs({x})"
    steps = "".join(
        f" WHEN {a} < {1024 ** (i + 1)} THEN printf('%.1f {unit}', {x} / {float(1024**i)!r})"
        for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"])
    )
    return (
        f"CASE WHEN {x} IS NULL OR {x} = 0 THEN '0 B'{steps} "
        f"ELSE printf('%.1f PB', {x} / {float(1024**5)!r}) END"
    )


def _age_label(s: str) -> str:
    def whole(unit: int) -> str:
        return f"CAST(trunc(({s}) / {unit}.0) AS BIGINT)"

    return (
        f"CASE WHEN ({s}) IS NULL THEN 'N/A' WHEN ({s}) < 60 THEN concat({whole(1)}, 's') "
        f"WHEN ({s}) < 3600 THEN concat({whole(60)}, 'm') "
        f"WHEN ({s}) < 86400 THEN concat({whole(3600)}, 'h') ELSE concat({whole(86400)}, 'd') END"
    )


def _age(ts: str = "collected_at") -> str:
    return f"date_diff('microsecond', {ts}, {_NOW}) / 1e6"


def _pct(new: str, old: str) -> str:
    return f"CASE WHEN {old} > 0 THEN ({new} - {old}) * CAST(100 AS DOUBLE) / {old} ELSE CAST(0 AS DOUBLE) END"


# --- ingest -------------------------------------------------------------------------

# A document is lost when it is cut short or of another type, and nameless without its key.
_KIND = """
kinds AS (
  SELECT *, CASE WHEN id % 17 = 0 THEN 'cut' WHEN id % 19 = 0 THEN 'nameless'
                 WHEN id % 23 = 0 THEN 'note' WHEN id % 29 = 0 THEN 'no utilized'
                 WHEN id % 31 = 0 THEN 'null shards' WHEN id % 37 = 0 THEN 'text shards'
                 WHEN id % 41 = 0 THEN 'array' WHEN id % 43 = 0 THEN 'no owner'
                 ELSE 'good' END AS kind
  FROM hist)
"""

_put(
    "ingest_snapshot",
    f""", {_KIND}
SELECT id AS seq, bucket_name, concat('id-', user_id) AS bucket_id, '' AS marker,
       CASE WHEN kind = 'no owner' THEN '' ELSE concat('user-', user_id % 10) END AS owner,
       'default-placement' AS placement_rule,
       CAST(CASE WHEN kind = 'null shards' THEN 0 ELSE 11 + user_id % 5 END AS INTEGER) AS num_shards,
       'Normal' AS index_type, 'off' AS versioning, false AS versioned,
       size_bytes, CAST(ceil(size_bytes / 4096.0) * 4096 AS BIGINT) AS size_actual_bytes,
       CASE WHEN kind = 'no utilized' THEN 0 ELSE size_bytes END AS size_utilized_bytes,
       num_objects, collected_at
FROM kinds WHERE kind NOT IN ('cut', 'nameless', 'text shards', 'array')
""",
)
_put(
    "ingest_quarantine",
    f""", {_KIND}
SELECT CASE WHEN kind = 'nameless' THEN 'no entity name' ELSE 'unreadable' END AS reason,
       count(*) AS documents, min(collected_at) AS first_seen
FROM kinds WHERE kind IN ('cut', 'nameless', 'text shards', 'array') GROUP BY 1
""",
)
_put(
    "ingest_arrays",
    "SELECT id AS seq, bucket_name, size_bytes, num_objects, collected_at FROM hist",
)
_put(
    "ingest_cut_arrays",
    """, filed AS (
  SELECT *, CAST(floor(id / 2000) AS BIGINT) AS file_number FROM hist),
ends AS (SELECT *, id = max(id) OVER (PARTITION BY file_number) AS is_last FROM filed)
SELECT file_number,
       count(*) FILTER (NOT (is_last AND file_number % 3 = 0)) AS documents,
       CAST(coalesce(sum(size_bytes) FILTER (NOT (is_last AND file_number % 3 = 0)), 0) AS BIGINT) AS size_bytes,
       CAST(CASE WHEN file_number % 3 = 1 THEN 0 ELSE 1 END AS BIGINT) AS unreadable
FROM ends GROUP BY file_number
""",
)
_put(
    "inventory_files",
    """
SELECT page, pos, concat('bucket-', o_orderkey) AS bucket_name
FROM (SELECT o_orderkey, page, row_number() OVER (PARTITION BY page ORDER BY o_orderkey) - 1 AS pos
      FROM (SELECT o_orderkey, CAST(floor(o_orderkey / 2000) AS BIGINT) AS page FROM orders))
WHERE o_orderkey % 4 <> 1
""",
)
_put(
    "ingest_one",
    f""", {_KIND}
SELECT bucket_name,
       CASE WHEN kind = 'no owner' THEN '' ELSE concat('user-', user_id % 10) END AS owner,
       size_bytes, num_objects, collected_at
FROM kinds WHERE user_id = 3 AND kind NOT IN ('cut', 'nameless', 'text shards', 'array')
""",
)
_put(
    "inventory_names",
    """
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY c_custkey) - 1 AS INTEGER) AS pos,
       concat('bucket-', c_custkey) AS bucket_name
FROM (SELECT c_custkey, CAST(floor(c_custkey / 100) AS BIGINT) AS page FROM customer)
QUALIFY c_custkey % 5 <> 4
""",
)
_put(
    "sync_parse_json",
    """, lag AS (
  SELECT id, k, NOT (id % 7 = 0 OR id % 11 = 0) AS listed,
         k % 10 + k % 2 AS shards, CASE WHEN id % 2 = 0 THEN k * 10 ELSE 0 END AS entries
  FROM hist)
SELECT id, CASE WHEN listed AND (shards > 0 OR entries > 0) THEN 'behind' ELSE 'synced' END AS sync_status,
       CAST(CASE WHEN listed THEN shards ELSE 0 END AS BIGINT) AS sync_behind_shards,
       CAST(CASE WHEN listed THEN entries ELSE 0 END AS BIGINT) AS sync_behind_entries,
       CASE WHEN listed THEN concat('zone-', k % 3) ELSE '' END AS sync_source_zone
FROM lag
""",
)
_put(
    "sync_parse_text",
    """
SELECT id,
       CASE id % 5 WHEN 0 THEN 'behind' WHEN 1 THEN 'behind' WHEN 2 THEN 'synced'
                   WHEN 3 THEN 'error' ELSE 'synced' END AS sync_status,
       CAST(CASE id % 5 WHEN 0 THEN k % 10 WHEN 1 THEN k % 10 WHEN 2 THEN k ELSE 0 END AS BIGINT)
         AS sync_behind_shards,
       CAST(CASE id % 5 WHEN 0 THEN k * 10 ELSE 0 END AS BIGINT) AS sync_behind_entries,
       CASE id % 5 WHEN 0 THEN concat('zone-', k % 3) WHEN 2 THEN 'zone-7' ELSE '' END AS sync_source_zone
FROM hist
""",
)
_put(
    "sync_status_resolve",
    """
SELECT id,
       CASE id % 6 WHEN 0 THEN CASE WHEN k % 10 > 0 THEN 'behind' ELSE 'synced' END
                   WHEN 1 THEN 'behind' WHEN 2 THEN 'not_multisite' WHEN 5 THEN 'not_multisite'
                   ELSE 'unknown' END AS sync_status,
       CAST(CASE id % 6 WHEN 0 THEN k % 10 ELSE 0 END AS BIGINT) AS sync_behind_shards,
       CAST(CASE id % 6 WHEN 1 THEN k ELSE 0 END AS BIGINT) AS sync_behind_entries,
       CASE id % 6 WHEN 0 THEN 'zone-1' ELSE '' END AS sync_source_zone
FROM hist
""",
)
_put(
    "stats_with_sync",
    """
SELECT bucket_name, owner, size_bytes,
       CASE WHEN user_id % 3 <> 0 THEN 'behind' ELSE sync_status END AS sync_status,
       CAST(CASE WHEN user_id % 3 <> 0 THEN num_objects ELSE sync_behind_shards END AS BIGINT)
         AS sync_behind_shards,
       CAST(CASE WHEN user_id % 3 <> 0 THEN 0 ELSE sync_behind_entries END AS BIGINT)
         AS sync_behind_entries,
       CASE WHEN user_id % 3 <> 0 THEN 'zone-1' ELSE '' END AS sync_source_zone
FROM cur
""",
)

# --- records and documents ----------------------------------------------------------

_put(
    "normalize_stats",
    """
SELECT bucket_name, bucket_id, bucket_id AS marker, tenant, owner, zonegroup, placement_rule,
       num_shards, index_type, 'off' AS versioning, versioned, versioning_enabled,
       object_lock_enabled, mfa_enabled, ver, master_ver, max_marker, mtime, creation_time,
       total_size AS size_bytes, total_size_actual AS size_actual_bytes,
       total_size_utilized AS size_utilized_bytes, total_num_objects AS num_objects,
       collected_at, collection_duration_ms
FROM cur JOIN usage_json USING (bucket_name)
""",
)
_put(
    "normalize_all",
    f"""
SELECT bucket_name, bucket_id, bucket_id AS marker, tenant, owner, zonegroup, placement_rule,
       CAST({_EMPTY_PLACEMENT} AS VARCHAR) AS explicit_placement,
       num_shards, index_type, 'off' AS versioning, versioned, versioning_enabled,
       object_lock_enabled, mfa_enabled, ver, master_ver, max_marker, mtime, creation_time,
       total_size AS size_bytes, total_size_actual AS size_actual_bytes,
       total_size_utilized AS size_utilized_bytes, total_num_objects AS num_objects,
       CAST(usage AS VARCHAR) AS usage, CAST({_DEFAULT_QUOTA} AS VARCHAR) AS bucket_quota,
       '' AS sync_status, CAST(0 AS BIGINT) AS sync_behind_shards, CAST(0 AS BIGINT) AS sync_behind_entries,
       '' AS sync_source_zone, collected_at, collection_duration_ms
FROM cur JOIN usage_json USING (bucket_name)
""",
)
_put(
    "usage_totals",
    """
SELECT bucket_name, total_size, total_size_actual, total_size_utilized, total_num_objects
FROM cur JOIN usage_json USING (bucket_name)
""",
)
_put(
    "usage_explode",
    """
SELECT u.bucket_name, u.storage_class, u.size_bytes, u.size_actual_bytes,
       u.size_utilized_bytes, u.num_objects, c.collected_at
FROM usage u JOIN cur c USING (bucket_name)
""",
)
_put(
    "record_to_json",
    """
SELECT bucket_name, CAST(json_object(
  'bucket_name', bucket_name, 'bucket_id', bucket_id, 'marker', marker, 'tenant', tenant,
  'owner', owner, 'zonegroup', zonegroup, 'placement_rule', placement_rule,
  'explicit_placement', explicit_placement, 'num_shards', num_shards, 'index_type', index_type,
  'versioning', versioning, 'versioned', versioned, 'versioning_enabled', versioning_enabled,
  'object_lock_enabled', object_lock_enabled, 'mfa_enabled', mfa_enabled, 'ver', ver,
  'master_ver', master_ver, 'max_marker', max_marker, 'mtime', mtime,
  'creation_time', creation_time, 'size_bytes', size_bytes,
  'size_actual_bytes', size_actual_bytes, 'size_utilized_bytes', size_utilized_bytes,
  'num_objects', num_objects, 'usage', usage, 'bucket_quota', bucket_quota,
  'sync_status', sync_status, 'sync_behind_shards', sync_behind_shards,
  'sync_behind_entries', sync_behind_entries, 'sync_source_zone', sync_source_zone,
  'collected_at', strftime(collected_at, '%Y-%m-%dT%H:%M:%S.%f'),
  'collection_duration_ms', collection_duration_ms) AS VARCHAR) AS record
FROM cur JOIN usage_json USING (bucket_name)
""",
)
_DOCUMENT = f"""
SELECT bucket_name, CAST(json_object(
  'bucket', bucket_name, 'num_shards', num_shards, 'tenant', tenant, 'versioning', 'off',
  'zonegroup', zonegroup, 'placement_rule', placement_rule,
  'explicit_placement', {_EMPTY_PLACEMENT}, 'id', bucket_id, 'marker', bucket_id,
  'index_type', index_type, 'versioned', versioned, 'versioning_enabled', versioning_enabled,
  'object_lock_enabled', object_lock_enabled, 'mfa_enabled', mfa_enabled, 'owner', owner,
  'ver', ver, 'master_ver', master_ver, 'mtime', mtime, 'creation_time', creation_time,
  'max_marker', max_marker, 'usage', usage, 'bucket_quota', {_DEFAULT_QUOTA}) AS VARCHAR) AS document
FROM cur JOIN usage_json USING (bucket_name)
"""
_put("export_one", f"{_DOCUMENT} WHERE bucket_name = 'bucket-3'")
_put("export_all", f"{_DOCUMENT} ORDER BY bucket_name")
_put("export_text_found", f"{_DOCUMENT} WHERE bucket_name = 'bucket-3'")
_put("export_files", f"SELECT document FROM ({_DOCUMENT})")
_put(
    "export_text_missing",
    """
SELECT 'no-such-bucket' AS bucket_name,
       CASE WHEN count(*) = 0 THEN '{}' ELSE 'found' END AS document
FROM cur WHERE bucket_name = 'no-such-bucket'
""",
)

# --- table maintenance --------------------------------------------------------------

_put(
    "upsert_current",
    """
SELECT l.bucket_name, l.size_bytes, l.num_objects, s.sync_status, s.sync_behind_shards,
       l.collected_at, l.id
FROM latest l LEFT JOIN (
  SELECT bucket_name, CASE WHEN k > 0 THEN 'behind' ELSE 'synced' END AS sync_status,
         sync_behind_shards
  FROM hist WHERE k % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY bucket_name ORDER BY collected_at DESC, id DESC) = 1) s
USING (bucket_name)
""",
)
_put("upsert_usage", "SELECT * FROM usage")
_put(
    "append_history",
    """
SELECT id, bucket_name, size_bytes, num_objects, sync_behind_shards, sync_behind_entries,
       collected_at, strftime(collected_at, '%Y-%m-%d') AS collected_date
FROM hist
""",
)
_put(
    "bulk_refresh",
    f""", {_KIND}
SELECT count(*) FILTER (kind NOT IN ('cut', 'nameless', 'array')) AS fetched,
       count(*) FILTER (kind NOT IN ('cut', 'nameless', 'array', 'text shards')) AS collected,
       count(*) FILTER (kind = 'text shards') AS errors, 'bulk' AS mode
FROM kinds
""",
)
_STATE = """bucket_name, concat('user-', user_id % 10) AS owner,
       CAST(11 + user_id % 5 AS INTEGER) AS num_shards, size_bytes, num_objects, collected_at"""
_put(
    "incremental_refresh",
    f""", stored AS (
  SELECT * FROM hist WHERE collected_at < {_ARRIVALS}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY collected_at DESC, id DESC) = 1)
SELECT {_STATE} FROM latest WHERE bucket_name IN (
  SELECT bucket_name FROM stored WHERE collected_at < {_ARRIVALS} - INTERVAL 6 HOURS)
UNION ALL
SELECT {_STATE} FROM stored WHERE collected_at >= {_ARRIVALS} - INTERVAL 6 HOURS
""",
)
_put(
    "refresh_once",
    f""", stored AS (
  SELECT * FROM hist WHERE collected_at < {_ARRIVALS}
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY collected_at DESC, id DESC) = 1),
due AS (
  SELECT bucket_name FROM inv WHERE bucket_name NOT IN (SELECT bucket_name FROM stored)
  UNION ALL
  SELECT bucket_name FROM stored WHERE collected_at < {_ARRIVALS} - INTERVAL 1800 SECONDS),
numbers AS (
  SELECT (SELECT count(*) FROM due) AS to_update, (SELECT count(*) FROM inv) AS total_buckets,
         (SELECT count(*) FROM stored) AS in_db,
         (SELECT count(*) FROM hist WHERE collected_at >= {_ARRIVALS}) AS arrived,
         (SELECT count(*) FROM hist WHERE collected_at >= {_ARRIVALS}
            AND bucket_name IN (SELECT bucket_name FROM due)) AS arrived_due)
SELECT CASE WHEN to_update > 500 THEN arrived ELSE arrived_due END AS fetched,
       CASE WHEN to_update > 500 THEN arrived ELSE arrived_due END AS collected,
       CAST(0 AS BIGINT) AS errors,
       CASE WHEN to_update > 500 THEN 'bulk' WHEN to_update > 0 THEN 'per-bucket' ELSE 'none' END AS mode,
       total_buckets, in_db, to_update
FROM numbers
""",
)
_put("refresh_landed", f"SELECT {_STATE} FROM latest")
_put(
    "refresh_counters",
    f""", {_KIND},
offered AS (
  SELECT 'bulk' AS mode, 1 AS version, kind, true AS listed FROM kinds
  UNION ALL
  SELECT 'per-bucket', 2, kind, kind NOT IN ('cut', 'nameless', 'array')
    AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) FROM kinds)
SELECT CAST(version AS BIGINT) AS version, mode, count(*) AS landed,
       count(*) FILTER (listed AND kind NOT IN ('cut', 'nameless', 'array', 'text shards')) AS collected,
       count(*) FILTER (kind IN ('cut', 'nameless', 'array') OR listed AND kind = 'text shards') AS errors,
       count(*) FILTER (kind IN ('cut', 'array') OR listed AND kind = 'text shards') AS unreadable,
       count(*) FILTER (kind = 'nameless') AS nameless,
       count(*) FILTER (NOT listed AND kind NOT IN ('cut', 'nameless', 'array')) AS skipped,
       CAST(0 AS BIGINT) AS readings
FROM offered GROUP BY version, mode
""",
)
# The documents as they landed, as far as their lengths go.
_put(
    "refresh_quarantine",
    f""", {_KIND},
texts AS (
  SELECT *, concat('{{"bucket":"', bucket_name, '","num_shards":', 11 + user_id % 5, ',"id":"id-', user_id,
    '","placement_rule":"default-placement","owner":"user-', user_id % 10, '","usage":{{"', storage_class,
    '":{{"size":', size_bytes, ',"size_actual":', CAST(ceil(size_bytes / 4096.0) * 4096 AS BIGINT),
    ',"size_utilized":', size_bytes, ',"num_objects":', num_objects, '}}}}}}') AS whole FROM kinds)
SELECT CAST(1 AS BIGINT) AS version,
       CASE WHEN kind = 'nameless' THEN 'no entity name' ELSE 'unreadable' END AS reason,
       count(*) AS documents,
       CAST(sum(CASE kind WHEN 'cut' THEN 20 WHEN 'array' THEN 6 WHEN 'nameless' THEN length(whole) - 1
                ELSE length(whole) + length('"many","other":') END) AS BIGINT) AS characters,
       max(collected_at) AS last_seen
FROM texts WHERE kind IN ('cut', 'nameless', 'text shards', 'array') GROUP BY 2
""",
)
_put(
    "stream_refresh_with_sync",
    """
SELECT bucket_name, size_bytes,
       CASE WHEN user_id % 3 <> 0 THEN 'behind' END AS sync_status,
       CASE WHEN user_id % 3 <> 0 THEN num_objects END AS sync_behind_shards,
       CASE WHEN user_id % 3 <> 0 THEN size_bytes * 1000000 END AS sync_behind_entries,
       CASE WHEN user_id % 3 <> 0 THEN 'zone-1' END AS sync_source_zone
FROM latest
""",
)
_put(
    "published_worklist",
    """
SELECT bucket_name, 'stale' AS reason FROM latest WHERE user_id % 4 <> 0
UNION ALL
SELECT bucket_name, 'uncollected' AS reason FROM inv
WHERE bucket_name NOT IN (SELECT bucket_name FROM latest WHERE user_id % 4 <> 0)
""",
)
_put("stream_refresh", f"SELECT {_STATE} FROM latest")
_put(
    "conform_schema",
    """
SELECT bucket_name, owner, '' AS marker, CAST(0 AS INTEGER) AS num_shards, '' AS index_type,
       false AS versioned, size_bytes, CAST(0 AS BIGINT) AS size_utilized_bytes, '{}' AS usage,
       collected_at
FROM cur
""",
)
_put(
    "repair_null_ts",
    f"""
SELECT bucket_name, owner, size_bytes, coalesce(collected_at, {_NOW}) AS collected_at
FROM cur_nulls
""",
)
_put(
    "repair_dry_run",
    "SELECT count(*) FILTER (collected_at IS NULL) AS null_collected_at FROM cur_nulls",
)

_TEXT = "strftime(collected_at, '%Y-%m-%d %H:%M:%S.%f')"


def _section(name: str, pairs: str, order: str | None, source: str) -> str:
    rank = f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER)" if order else "CAST(0 AS INTEGER)"
    return (
        f"SELECT '{name}' AS section, {rank} AS rank, "
        f"CAST(json_object({pairs}) AS VARCHAR) AS json FROM {source}"
    )


_put(
    "serving_snapshot",
    "\nUNION ALL\n".join(
        [
            _section(
                "summary",
                "'total_buckets', n, 'total_owners', o, 'total_size_bytes', s, 'total_objects', b, "
                "'oldest_collection', strftime(lo, '%Y-%m-%d %H:%M:%S.%f'), "
                "'newest_collection', strftime(hi, '%Y-%m-%d %H:%M:%S.%f')",
                "n",
                "(SELECT count(*) AS n, count(DISTINCT owner) AS o, CAST(sum(size_bytes) AS BIGINT) AS s, "
                "CAST(sum(num_objects) AS BIGINT) AS b, min(collected_at) AS lo, max(collected_at) AS hi FROM cur)",
            ),
            _section(
                "top_by_size",
                "'bucket_name', bucket_name, 'owner', owner, 'size_bytes', size_bytes, "
                "'size_actual_bytes', size_actual_bytes, 'num_objects', num_objects, "
                f"'num_shards', num_shards, 'collected_at', {_TEXT}",
                "size_bytes DESC, bucket_name",
                "(SELECT * FROM cur ORDER BY size_bytes DESC, bucket_name LIMIT 100)",
            ),
            _section(
                "top_by_objects",
                "'bucket_name', bucket_name, 'owner', owner, 'size_bytes', size_bytes, "
                f"'num_objects', num_objects, 'collected_at', {_TEXT}",
                "num_objects DESC, bucket_name",
                "(SELECT * FROM cur ORDER BY num_objects DESC, bucket_name LIMIT 100)",
            ),
            _section(
                "freshness",
                "'freshness', band, 'count', n",
                "band",
                f"(SELECT CASE WHEN collected_at >= {_NOW} - INTERVAL 10 MINUTES THEN 'fresh_10m' "
                f"WHEN collected_at >= {_NOW} - INTERVAL 1 HOUR THEN 'fresh_1h' "
                f"WHEN collected_at >= {_NOW} - INTERVAL 24 HOURS THEN 'fresh_24h' ELSE 'stale' END "
                "AS band, count(*) AS n FROM cur GROUP BY 1)",
            ),
            _section(
                "by_owner",
                "'owner', owner, 'bucket_count', n, 'total_size', s, 'total_objects', b",
                "s DESC, owner",
                "(SELECT owner, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS s, "
                "CAST(sum(num_objects) AS BIGINT) AS b FROM cur GROUP BY owner "
                "ORDER BY s DESC, owner LIMIT 50)",
            ),
            _section(
                "all_buckets",
                "'bucket_name', bucket_name, 'owner', owner, 'size_bytes', size_bytes, "
                f"'num_objects', num_objects, 'collected_at', {_TEXT}, 'num_shards', num_shards",
                None,
                "cur",
            ),
            _section(
                "sync_summary",
                "'sync_status', sync_status, 'count', n",
                "sync_status",
                "(SELECT sync_status, count(*) AS n FROM cur WHERE sync_status <> '' GROUP BY 1)",
            ),
            _section(
                "sync_behind",
                "'bucket_name', bucket_name, 'owner', owner, 'sync_status', sync_status, "
                "'shards_behind', sync_behind_shards, 'entries_behind', sync_behind_entries",
                "sync_behind_entries DESC, bucket_name",
                "(SELECT * FROM cur WHERE sync_behind_shards > 0 OR sync_behind_entries > 0 "
                "ORDER BY sync_behind_entries DESC, bucket_name LIMIT 50)",
            ),
        ]
    ),
)
_put(
    "serving_read",
    f"""
SELECT bucket_name, owner, size_bytes, size_actual_bytes, num_objects, num_shards,
       {_TEXT} AS collected_at
FROM cur ORDER BY size_bytes DESC, bucket_name LIMIT 10
""",
)
_put(
    "serving_read_all",
    f"""
SELECT bucket_name, owner, size_bytes, num_objects, {_TEXT} AS collected_at, num_shards
FROM cur ORDER BY bucket_name
""",
)
_put(
    "serving_read_table",
    f"""
SELECT bucket_name, concat('user-', user_id % 10) AS owner, size_bytes, num_objects,
       {_TEXT} AS collected_at, CAST(11 + user_id % 5 AS INTEGER) AS num_shards
FROM latest
""",
)
_put(
    "serving_age",
    f"""
SELECT {_NOW} - INTERVAL 90 SECONDS AS updated, CAST(90 AS DOUBLE) AS age_seconds,
       max(collected_at) AS newest, {_age("max(collected_at)")} AS data_age_seconds
FROM cur
""",
)

# --- lookups, lists, top-k ----------------------------------------------------------

_put(
    "entity_row",
    """
SELECT c.* EXCLUDE (user_id), CAST(usage AS VARCHAR) AS usage
FROM cur c JOIN usage_json USING (bucket_name) WHERE bucket_name = 'bucket-3'
""",
)
_put(
    "entity_details",
    """
SELECT bucket_name, bucket_id, tenant, owner, zonegroup, placement_rule, num_shards, size_bytes,
       size_actual_bytes, num_objects, classes AS storage_classes, sync_status,
       sync_behind_shards, collected_at
FROM cur JOIN usage_json USING (bucket_name) WHERE bucket_name = 'bucket-3'
""",
)
_SERIES = f"""
SELECT collected_at, size_bytes, num_objects FROM hist
WHERE bucket_name = 'bucket-3' AND collected_at >= {_NOW} - INTERVAL 30 DAYS
"""
_put("entity_history", f"{_SERIES} ORDER BY collected_at")
_put("entity_history_last_n", f"{_SERIES} ORDER BY collected_at DESC, id DESC LIMIT 20")
_put(
    "top_by_size",
    """
SELECT bucket_name, owner, num_objects, size_bytes, collected_at
FROM cur ORDER BY size_bytes DESC, bucket_name LIMIT 20
""",
)
_put(
    "top_by_objects",
    """
SELECT bucket_name, owner, num_objects, size_bytes
FROM cur ORDER BY num_objects DESC, bucket_name LIMIT 20
""",
)
for _name, _source, _order in [
    ("size", "cur", "size_bytes DESC"),
    ("objects", "cur", "num_objects DESC"),
    ("age", "cur_nulls", "collected_at ASC NULLS LAST"),
    ("name", "cur", "bucket_name ASC"),
]:
    _put(
        f"listing_by_{_name}",
        f"""
SELECT bucket_name, owner, num_objects, size_bytes, sync_status,
       sync_behind_shards AS shards_behind, collected_at, {_age()} AS age_seconds
FROM {_source} ORDER BY {_order}, bucket_name LIMIT 100
""",
    )
_put(
    "all_entities",
    """
SELECT bucket_name, owner, size_bytes, num_objects, collected_at, num_shards
FROM cur ORDER BY bucket_name
""",
)
_put(
    "empty_entities",
    """
SELECT bucket_name, owner, num_objects, size_bytes, collected_at
FROM cur_empty WHERE num_objects = 0 ORDER BY bucket_name
""",
)
_put(
    "stale_for_refresh",
    f"""
SELECT bucket_name FROM cur_nulls
WHERE collected_at IS NULL OR collected_at < {_NOW} - INTERVAL 1800 SECONDS
ORDER BY collected_at ASC NULLS FIRST, bucket_name LIMIT 100
""",
)
_put(
    "stale_report",
    f"""
SELECT bucket_name, owner, collected_at FROM cur_nulls
WHERE collected_at < {_NOW} - INTERVAL 10 MINUTES ORDER BY collected_at, bucket_name LIMIT 100
""",
)

# --- summaries ----------------------------------------------------------------------

_put(
    "cluster_summary",
    """
SELECT count(*) AS total_buckets, count(DISTINCT owner) AS total_owners,
       CAST(coalesce(sum(num_objects), 0) AS BIGINT) AS total_objects,
       CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size_bytes,
       min(collected_at) AS oldest_data, max(collected_at) AS newest_data
FROM cur
""",
)
_OWNERS = """
SELECT owner, count(*) AS bucket_count, CAST(sum(num_objects) AS BIGINT) AS total_objects,
       CAST(sum(size_bytes) AS BIGINT) AS total_size
FROM cur GROUP BY owner ORDER BY total_size DESC, owner
"""
_put("summary_by_owner", f"{_OWNERS} LIMIT 50")
_put("summary_by_owner_all", _OWNERS)
_put(
    "storage_class_distribution",
    """
SELECT storage_class, count(DISTINCT bucket_name) AS bucket_count,
       CAST(sum(num_objects) AS BIGINT) AS total_objects, CAST(sum(size_bytes) AS BIGINT) AS total_size
FROM usage GROUP BY storage_class ORDER BY total_size DESC, storage_class
""",
)


def _fresh(interval: str) -> str:
    return f"count(*) FILTER (collected_at >= {_NOW} - INTERVAL {interval})"


_put(
    "collection_freshness",
    f"""
SELECT total, fresh_5m, fresh_5m * 100.0::DOUBLE / greatest(total, 1) AS fresh_5m_pct,
       fresh_10m, fresh_10m * 100.0::DOUBLE / greatest(total, 1) AS fresh_10m_pct,
       fresh_1h, fresh_1h * 100.0::DOUBLE / greatest(total, 1) AS fresh_1h_pct, oldest, newest
FROM (SELECT count(*) AS total, {_fresh('5 MINUTES')} AS fresh_5m,
             {_fresh('10 MINUTES')} AS fresh_10m, {_fresh('1 HOUR')} AS fresh_1h,
             min(collected_at) AS oldest, max(collected_at) AS newest FROM cur_nulls)
""",
)
_put(
    "freshness_bands",
    f"""
SELECT CASE WHEN collected_at >= {_NOW} - INTERVAL 10 MINUTES THEN 'fresh_10m'
            WHEN collected_at >= {_NOW} - INTERVAL 1 HOUR THEN 'fresh_1h'
            WHEN collected_at >= {_NOW} - INTERVAL 24 HOURS THEN 'fresh_24h'
            ELSE 'stale' END AS freshness, count(*) AS count
FROM cur_nulls GROUP BY 1
""",
)


def _stale(seconds: int) -> str:
    return (
        f"count(*) FILTER (collected_at IS NULL OR collected_at < {_NOW} - INTERVAL {seconds} SECONDS)"
    )


_put(
    "stale_count",
    f"SELECT CAST(1800 AS INTEGER) AS threshold_seconds, {_stale(1800)} AS stale_count FROM cur_nulls",
)
_put(
    "stale_ladder",
    "\nUNION ALL\n".join(
        f"SELECT CAST({s} AS INTEGER) AS threshold_seconds, '{label}' AS label, "
        f"{_stale(s)} AS stale_count FROM cur_nulls"
        for s, label in [(60, "1m"), (300, "5m"), (600, "10m"), (3600, "1h")]
    ),
)
_put(
    "timestamp_health",
    """
SELECT count(*) AS total, count(*) FILTER (collected_at IS NULL) AS null_collected_at,
       min(collected_at) AS oldest, max(collected_at) AS newest
FROM cur_nulls
""",
)
_put(
    "status_rollup",
    f"""
SELECT count(*) AS total_buckets, count(DISTINCT owner) AS total_owners,
       CAST(sum(num_objects) AS BIGINT) AS total_objects, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
       min(collected_at) AS oldest_collection, max(collected_at) AS newest_collection,
       count(*) FILTER (collected_at IS NULL) AS null_collected_at, {_stale(1800)} AS stale_buckets,
       {_stale(60)} AS stale_60s, {_stale(300)} AS stale_300s, {_stale(600)} AS stale_600s,
       {_stale(3600)} AS stale_3600s
FROM cur_nulls
""",
)

# --- growth and comparison ----------------------------------------------------------

_LAST_OF_DAY = """(SELECT * FROM hist QUALIFY row_number() OVER (
  PARTITION BY bucket_name, date_trunc('day', collected_at) ORDER BY collected_at DESC, id DESC) = 1)"""


def _growth(source: str, since: str) -> str:
    return f"""
SELECT date_trunc('day', collected_at) AS day, CAST(sum(size_bytes) AS BIGINT) AS total_size,
       CAST(sum(num_objects) AS BIGINT) AS total_objects
FROM {source} WHERE collected_at >= {since} GROUP BY 1 ORDER BY 1
"""


_MONTH = f"{_NOW} - INTERVAL 30 DAYS"
_WEEK = f"{_NOW} - INTERVAL 7 DAYS"
_put("cluster_growth", _growth("hist", _MONTH))
_put("cluster_growth_eod", _growth(_LAST_OF_DAY, _MONTH))
_put(
    "fastest_growing_entities",
    f"""
SELECT g.bucket_name, c.owner, g.start_size, g.end_size, g.end_size - g.start_size AS growth_bytes
FROM (SELECT bucket_name, min(size_bytes) AS start_size, max(size_bytes) AS end_size
      FROM hist WHERE collected_at >= {_WEEK} GROUP BY 1 HAVING count(*) >= 2) g
JOIN cur c USING (bucket_name) ORDER BY growth_bytes DESC, g.bucket_name LIMIT 20
""",
)
_put(
    "fastest_growing_owners",
    f"""
SELECT owner, CAST(min(size) AS BIGINT) AS start_size, CAST(max(size) AS BIGINT) AS end_size,
       CAST(max(size) - min(size) AS BIGINT) AS growth_bytes
FROM (SELECT c.owner, date_trunc('day', h.collected_at) AS day, sum(h.size_bytes) AS size
      FROM hist h JOIN cur c USING (bucket_name) WHERE h.collected_at >= {_WEEK} GROUP BY 1, 2)
GROUP BY owner ORDER BY growth_bytes DESC, owner LIMIT 20
""",
)

# Sizes far past what a bigint sum holds; totals as text.
_HUGE = "(SELECT * REPLACE (CAST(size_bytes AS HUGEINT) + 4611686018427387904 AS size_bytes) FROM hist)"
_put(
    "cluster_growth_wide",
    f"""
SELECT date_trunc('day', collected_at) AS day, CAST(sum(size_bytes) AS VARCHAR) AS total_size,
       CAST(sum(num_objects) AS VARCHAR) AS total_objects
FROM {_HUGE} WHERE collected_at >= {_MONTH} GROUP BY 1
""",
)
_put(
    "fastest_growing_owners_wide",
    f"""
SELECT owner, CAST(min(size) AS VARCHAR) AS start_size, CAST(max(size) AS VARCHAR) AS end_size,
       CAST(max(size) - min(size) AS VARCHAR) AS growth_bytes
FROM (SELECT c.owner, date_trunc('day', h.collected_at) AS day, sum(h.size_bytes) AS size
      FROM {_HUGE} h JOIN cur c USING (bucket_name) WHERE h.collected_at >= {_WEEK} GROUP BY 1, 2)
GROUP BY owner ORDER BY max(size) - min(size) DESC, owner LIMIT 100
""",
)
_put(
    "capacity_forecast_wide",
    f"""
SELECT CAST(arg_max(y, day) AS VARCHAR) AS current_bytes, count(*) AS data_points, CAST(NULL AS VARCHAR) AS error
FROM (SELECT date_trunc('day', collected_at) AS day, sum(size_bytes) AS y
      FROM {_HUGE} WHERE collected_at >= {_MONTH} GROUP BY 1)
""",
)


def _ends(source: str) -> str:
    return f"""
SELECT bucket_name, min(collected_at) AS first_collected_at,
       first(size_bytes ORDER BY collected_at, id) AS first_size_bytes,
       first(num_objects ORDER BY collected_at, id) AS first_num_objects,
       max(collected_at) AS last_collected_at,
       last(size_bytes ORDER BY collected_at, id) AS last_size_bytes,
       last(num_objects ORDER BY collected_at, id) AS last_num_objects, count(*) AS snapshots
FROM {source} GROUP BY bucket_name
"""


_put("first_last_per_entity", _ends("hist"))


def _forecast(source: str, since: str, by: str = "", digits: int | None = 4, ahead: int = 90) -> str:
    """Least squares in whole numbers (HUGEINT), one division."""
    group = f"{by}, " if by else ""
    partition = f"PARTITION BY {by}" if by else ""
    tail = f"GROUP BY {by}" if by else ""

    def out(x: str) -> str:
        return x if digits is None else f"round({x}, {digits})"

    return f"""
SELECT {group}current_bytes,
       {out(f"CASE WHEN slope IS NOT NULL THEN greatest(0.0::DOUBLE, current_bytes + slope * {ahead}) END")} AS forecast_bytes,
       CAST({ahead} AS INTEGER) AS forecast_days, {out("slope")} AS daily_growth_bytes,
       {out("slope * 30")} AS monthly_growth_bytes, data_points,
       CASE WHEN data_points < 2 THEN 'Insufficient data for forecast' END AS error
FROM (
  SELECT {group}count(*) AS data_points,
         CASE WHEN count(*) >= 2 THEN CAST(arg_max(y, x) AS BIGINT) END AS current_bytes,
         CASE WHEN count(*) >= 2 THEN
           CAST(count(*)::HUGEINT * sum(x * y) - sum(x)::HUGEINT * sum(y) AS DOUBLE)
           / CAST(count(*) * sum(x * x) - sum(x) * sum(x) AS DOUBLE) END AS slope
  FROM (SELECT {group}y, row_number() OVER ({partition} ORDER BY day) - 1 AS x
        FROM (SELECT {group}date_trunc('day', collected_at) AS day, CAST(sum(size_bytes) AS HUGEINT) AS y
              FROM {source} WHERE collected_at >= {since} GROUP BY {group}day))
  {tail})
"""


_put("capacity_forecast", _forecast("hist", _MONTH))
_put("capacity_forecast_eod", _forecast(_LAST_OF_DAY, _MONTH))
_put("capacity_forecast_by_entity", _forecast("hist", _MONTH, "bucket_name"))
_put(
    "compare_snapshots",
    f"""
SELECT c.s AS current_size_bytes, c.o AS current_objects, c.n AS current_buckets,
       h.s AS historical_size_bytes, h.o AS historical_objects, h.n AS historical_buckets,
       c.s - h.s AS delta_size_bytes, c.o - h.o AS delta_objects, CAST(24 AS INTEGER) AS period_hours
FROM (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS s,
             CAST(coalesce(sum(num_objects), 0) AS BIGINT) AS o, count(*) AS n FROM cur) c,
     (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS s,
             CAST(coalesce(sum(num_objects), 0) AS BIGINT) AS o, count(DISTINCT bucket_name) AS n
      FROM hist WHERE collected_at BETWEEN {_NOW} - INTERVAL 25 HOURS AND {_NOW} - INTERVAL 24 HOURS) h
""",
)
_put(
    "entity_changes",
    f"""
SELECT g.bucket_name, c.owner, old_size, new_size, new_size - old_size AS delta,
       round({_pct('new_size', 'old_size')}, 6) AS change_pct
FROM (SELECT bucket_name, first(size_bytes ORDER BY collected_at, id) AS old_size,
             last(size_bytes ORDER BY collected_at, id) AS new_size
      FROM hist WHERE collected_at >= {_NOW} - INTERVAL 24 HOURS GROUP BY 1 HAVING count(*) >= 2) g
JOIN cur c USING (bucket_name)
WHERE abs({_pct('new_size', 'old_size')}) >= 10.0
ORDER BY abs(delta) DESC, g.bucket_name
""",
)


def _comparison(limit: int) -> str:
    return f"""
SELECT c.bucket_name, c.owner, c.size_bytes AS current_size, c.num_objects AS current_objects,
       coalesce(h.old_size, c.size_bytes) AS old_size,
       coalesce(h.old_objects, c.num_objects) AS old_objects,
       c.size_bytes - coalesce(h.old_size, c.size_bytes) AS size_delta,
       c.num_objects - coalesce(h.old_objects, c.num_objects) AS obj_delta,
       {_pct('c.size_bytes', 'h.old_size')} AS size_pct_change,
       c.collected_at AS current_time, h.old_time
FROM cur c LEFT JOIN (
  SELECT bucket_name, first(size_bytes ORDER BY collected_at, id) AS old_size,
         first(num_objects ORDER BY collected_at, id) AS old_objects, min(collected_at) AS old_time
  FROM hist WHERE collected_at >= {_WEEK} AND collected_at <= {_WEEK} + INTERVAL 1 DAY
  GROUP BY bucket_name) h USING (bucket_name)
ORDER BY abs(size_delta) DESC, c.bucket_name LIMIT {limit}
"""


_put(
    "entity_comparison",
    f"""
SELECT * REPLACE (round(size_pct_change, 6) AS size_pct_change) FROM ({_comparison(50)})
""",
)

# --- replication --------------------------------------------------------------------

_put(
    "sync_status_summary",
    """
SELECT sync_status, count(*) AS bucket_count, CAST(sum(sync_behind_shards) AS BIGINT) AS shards_behind
FROM cur WHERE sync_status IS NOT NULL AND sync_status <> ''
GROUP BY sync_status ORDER BY bucket_count DESC, sync_status
""",
)
_put(
    "lagging_by_shards",
    """
SELECT bucket_name, owner, sync_status, sync_behind_shards AS shards_behind, size_bytes
FROM cur WHERE sync_behind_shards > 0 ORDER BY sync_behind_shards DESC, bucket_name LIMIT 50
""",
)
_put(
    "lagging_by_entries",
    """
SELECT bucket_name, owner, sync_status, sync_behind_shards AS shards_behind,
       sync_behind_entries AS entries_behind
FROM cur WHERE sync_behind_shards > 0 OR sync_behind_entries > 0
ORDER BY sync_behind_entries DESC, bucket_name LIMIT 50
""",
)


def _sync(limit: int, only: str = "true") -> str:
    return f"""
SELECT c.bucket_name, c.owner, c.sync_status, c.sync_behind_shards AS shards_behind,
       c.sync_behind_entries AS entries_behind, c.size_bytes,
       round(coalesce(h.avg_shards, 0), 6) AS avg_shards_24h,
       coalesce(h.max_shards, 0) AS max_shards_24h, c.collected_at
FROM cur c LEFT JOIN (
  SELECT bucket_name, avg(sync_behind_shards) AS avg_shards, max(sync_behind_shards) AS max_shards
  FROM hist WHERE collected_at >= {_NOW} - INTERVAL 24 HOURS GROUP BY 1) h USING (bucket_name)
WHERE c.sync_status IS NOT NULL AND c.sync_status <> '' AND ({only})
ORDER BY shards_behind DESC, c.bucket_name LIMIT {limit}
"""


_put("sync_comparison", _sync(50))

# --- work lists ---------------------------------------------------------------------

_put("uncollected", "SELECT bucket_name FROM missing ORDER BY pos LIMIT 100")
_put("uncollected_all", "SELECT bucket_name FROM missing ORDER BY pos")
_STALE_ROWS = f"""
SELECT bucket_name, collected_at FROM cur_nulls
WHERE collected_at IS NULL OR collected_at < {_NOW} - INTERVAL 1800 SECONDS
"""
_put(
    "refresh_worklist",
    f"""
SELECT bucket_name, 'uncollected' AS reason FROM missing
UNION ALL SELECT bucket_name, 'stale' FROM ({_STALE_ROWS})
""",
)
_put(
    "refresh_worklist_prioritised",
    f"""
SELECT bucket_name, CAST(priority AS INTEGER) AS priority FROM (
  SELECT bucket_name, 0 AS priority, pos, NULL::TIMESTAMP AS collected_at FROM missing
  UNION ALL SELECT bucket_name, 1, NULL, collected_at FROM ({_STALE_ROWS}))
ORDER BY priority, pos, collected_at NULLS FIRST, bucket_name LIMIT 1400
""",
)


def _plan(threshold: int) -> str:
    return f"""
SELECT *, CASE WHEN to_update = 0 THEN 'none' WHEN to_update > {threshold} THEN 'bulk'
               ELSE 'per-bucket' END AS mode
FROM (SELECT total_buckets, in_db, uncollected, stale, uncollected + stale AS to_update, orphans
      FROM (SELECT (SELECT count(*) FROM inv) AS total_buckets, (SELECT count(*) FROM cur) AS in_db,
                   (SELECT count(*) FROM missing) AS uncollected,
                   (SELECT count(*) FROM ({_STALE_ROWS})) AS stale,
                   (SELECT count(*) FROM cur WHERE bucket_name NOT IN (SELECT bucket_name FROM inv)) AS orphans))
"""


_put("refresh_plan", _plan(500))
_put("refresh_plan_per_bucket", _plan(5_000_000))

# --- reports and free SQL -----------------------------------------------------------

_put(
    "listing_report",
    f"""
SELECT substr(bucket_name, 1, 40) AS bucket_name, substr(owner, 1, 15) AS owner, num_objects,
       {_bytes_label('size_bytes')} AS size,
       concat(coalesce(nullif(sync_status, ''), '-'),
              CASE WHEN sync_behind_shards > 0 THEN concat(' (', sync_behind_shards, ')') ELSE '' END) AS sync,
       {_age_label('age')} AS age,
       CASE WHEN age > 3600 THEN 'red' WHEN age > 600 THEN 'yellow' ELSE 'green' END AS severity
FROM (SELECT *, coalesce({_age()}, 0) AS age FROM cur_nulls
      ORDER BY collected_at ASC NULLS LAST, bucket_name LIMIT 50)
""",
)
_put(
    "top_report",
    f"""
SELECT substr(bucket_name, 1, 40) AS bucket_name, substr(owner, 1, 20) AS owner, num_objects,
       {_bytes_label('size_bytes')} AS size, {_age_label(_age())} AS age
FROM (SELECT * FROM cur ORDER BY size_bytes DESC, bucket_name LIMIT 20)
""",
)
_put(
    "comparison_report",
    f"""
SELECT substr(bucket_name, 1, 35) AS bucket_name, substr(owner, 1, 15) AS owner,
       {_bytes_label('current_size')} AS current, {_bytes_label('old_size')} AS past,
       CASE WHEN size_delta > 0 THEN '+' ELSE '' END || {_bytes_label('size_delta')} AS delta,
       CASE WHEN size_delta = 0 THEN '0%' ELSE
         CASE WHEN size_delta > 0 THEN '+' ELSE '' END || printf('%.1f%%', size_pct_change) END AS change
FROM ({_comparison(30)})
""",
)
_put(
    "sync_report",
    f"""
SELECT substr(bucket_name, 1, 35) AS bucket_name, substr(owner, 1, 15) AS owner, sync_status,
       shards_behind, entries_behind, avg_shards_24h
FROM ({_sync(30, "c.sync_behind_shards > 0 OR c.sync_behind_entries > 0")})
""",
)
_put(
    "growth_report",
    f"""
SELECT substr(bucket_name, 1, 35) AS bucket_name, substr(owner, 1, 15) AS owner,
       {_bytes_label('start_size')} AS start, {_bytes_label('end_size')} AS end,
       CASE WHEN growth_bytes > 0 THEN '+' ELSE '' END || {_bytes_label('growth_bytes')} AS growth
FROM (SELECT g.bucket_name, c.owner, g.start_size, g.end_size, g.end_size - g.start_size AS growth_bytes
      FROM (SELECT bucket_name, min(size_bytes) AS start_size, max(size_bytes) AS end_size
            FROM hist WHERE collected_at >= {_WEEK} GROUP BY 1 HAVING count(*) >= 2) g
      JOIN cur c USING (bucket_name) ORDER BY growth_bytes DESC, g.bucket_name LIMIT 20)
""",
)
_put(
    "forecast_report",
    f"""
SELECT {_bytes_label('current_bytes')} AS current, {_bytes_label('daily_growth_bytes')} AS daily_growth,
       {_bytes_label('monthly_growth_bytes')} AS monthly_growth,
       {_bytes_label('forecast_bytes')} AS forecast, error
FROM ({_forecast('hist', _WEEK, digits=None)})
""",
)
_put(
    "freshness_report",
    f"""
SELECT total, fresh_5m, fresh_10m, fresh_1h, total - fresh_1h AS stale,
       (total - fresh_1h) * 100.0::DOUBLE / greatest(total, 1) AS stale_pct
FROM (SELECT count(*) AS total, {_fresh('5 MINUTES')} AS fresh_5m,
             {_fresh('10 MINUTES')} AS fresh_10m, {_fresh('1 HOUR')} AS fresh_1h FROM cur)
""",
)
_put(
    "oldest_report",
    f"""
SELECT bucket_name, {_age_label(_age())} AS age
FROM (SELECT * FROM cur WHERE collected_at < {_NOW} - INTERVAL 5 MINUTES
      ORDER BY collected_at, bucket_name LIMIT 10)
""",
)
_put(
    "custom_sql",
    """
SELECT s.owner, u.storage_class, count(*) AS buckets, CAST(sum(u.size_bytes) AS BIGINT) AS size_bytes
FROM cur s JOIN usage u USING (bucket_name) WHERE u.num_objects >= 5
GROUP BY s.owner, u.storage_class
""",
)

# --- larger histories ---------------------------------------------------------------

_LINEITEM = """(SELECT l_orderkey * 8 + l_linenumber AS id, concat('bucket-', l_partkey) AS bucket_name,
  CAST(floor(l_extendedprice * 100) AS BIGINT) AS size_bytes,
  CAST(l_linenumber AS BIGINT) AS num_objects, l_shipdate AS collected_at FROM lineitem)"""
_put("cluster_growth_lineitem", _growth(_LINEITEM, "TIMESTAMP '2001-11-05' - INTERVAL 365 DAYS"))
_put("first_last_lineitem", _ends(_LINEITEM))
_put(
    "forecast_by_entity_lineitem",
    _forecast(_LINEITEM, "TIMESTAMP '2001-11-05' - INTERVAL 3650 DAYS", "bucket_name"),
)
_put(
    "upsert_orders",
    """
SELECT o_orderkey AS id, concat('bucket-', o_custkey) AS bucket_name,
       CAST(floor(o_totalprice * 100) AS BIGINT) AS size_bytes, CAST(1 AS BIGINT) AS num_objects,
       o_orderdate AS collected_at
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""",
)
