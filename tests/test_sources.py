"""Documents, inventories and replication status as they land."""

from __future__ import annotations

import json

import pytest
from conftest import NOW, rows_of
from pyspark.sql import functions as F

from usagelens.operators import export, normalize
from usagelens.sources import inventory, snapshots, sync

FULL = {
    "bucket": "full",
    "num_shards": 11,
    "tenant": "t",
    "versioning": "enabled",
    "zonegroup": "zg",
    "placement_rule": "default-placement",
    "explicit_placement": {"data_pool": "d", "data_extra_pool": "e", "index_pool": "i"},
    "id": "id-1",
    "marker": "m-1",
    "index_type": "Indexless",
    "versioned": True,
    "versioning_enabled": True,
    "object_lock_enabled": True,
    "mfa_enabled": True,
    "owner": "user123",
    "ver": "0#1",
    "master_ver": "0#0",
    "mtime": "2025-01-20T12:18:37.601118Z",
    "creation_time": "2025-01-20T12:18:37.593470Z",
    "max_marker": "0#",
    "usage": {
        "main": {
            "size": 410041,
            "size_actual": 413696,
            "size_utilized": 410041,
            "size_kb": 401,
            "size_kb_actual": 404,
            "size_kb_utilized": 401,
            "num_objects": 1,
        },
        "multimeta": {"size": 9, "num_objects": 2},
    },
    "bucket_quota": {
        "enabled": True,
        "check_on_raw": False,
        "max_size": 5,
        "max_size_kb": 6,
        "max_objects": 7,
    },
}
EDGES = [
    {"bucket": "empty usage", "usage": {}},
    {"bucket": "no usage"},
    {"bucket": "odd usage", "usage": {"note": "text", "n": 5, "l": [1], "z": None, "a": {"size": 3}}},
    {"bucket": "null measures", "usage": {"a": {"size": None, "num_objects": 4}, "b": {}}},
    {"bucket": "null shards", "num_shards": None},
]
BAD = [{"bucket": ""}, {"owner": "nameless"}, {"bucket": "text shards", "num_shards": "many"}]


def texts(spark, *values):
    rows = [(v if isinstance(v, str) else json.dumps(v), NOW) for v in values]
    return spark.createDataFrame(rows, "value string, collected_at timestamp_ntz")


def records(spark, *values):
    parsed = snapshots.parse_documents(texts(spark, *values))
    return normalize.normalize(snapshots.good_documents(parsed))


def test_full_document(spark):
    row = records(spark, FULL).first()
    assert (row.bucket_name, row.bucket_id, row.marker) == ("full", "id-1", "m-1")
    assert (row.size_bytes, row.size_actual_bytes, row.size_utilized_bytes) == (410050, 413696, 410041)
    assert row.num_objects == 3 and row.num_shards == 11 and row.mfa_enabled is True
    assert row.usage["main"].size_kb == 401 and row.explicit_placement.index_pool == "i"
    assert row.collected_at == NOW and row.sync_status is None


def test_edges_get_defaults(spark):
    got = {r.bucket_name: r for r in records(spark, *EDGES).collect()}
    assert len(got) == len(EDGES)
    for name in ["empty usage", "no usage", "null shards"]:
        r = got[name]
        assert (r.size_bytes, r.num_objects, r.usage, r.num_shards) == (0, 0, {}, 0)
        assert (r.index_type, r.versioning, r.versioned, r.owner) == ("Normal", "off", False, "")
    assert got["odd usage"].size_bytes == 3 and list(got["odd usage"].usage) == ["a"]
    assert (got["null measures"].size_bytes, got["null measures"].num_objects) == (0, 4)


def test_measures_that_are_no_whole_numbers(spark):
    """A float is a number; a text is an error that shows, not a silent 0."""
    odd = [
        {"bucket": "float", "usage": {"a": {"size": 1024.0, "num_objects": 3}, "b": {"size": 2**60}}},
        {"bucket": "text", "usage": {"a": {"size": "many"}}},
        {"bucket": "note and text", "usage": {"note": "x", "a": {"size": "many"}}},
        {"bucket": "note and owner", "owner": "o", "usage": {"note": "x", "a": {"size": 5}}},
        {"bucket": "usage is text", "usage": "none"},
    ]
    parsed = snapshots.parse_documents(texts(spark, *odd))
    got = {r.bucket_name: r for r in normalize.normalize(snapshots.good_documents(parsed)).collect()}
    assert sorted(got) == ["float", "note and owner"]
    assert (got["float"].size_bytes, got["float"].num_objects) == (2**60 + 1024, 3)
    assert (got["note and owner"].owner, got["note and owner"].size_bytes) == ("o", 5)
    assert snapshots.quarantine(parsed).filter("reason = 'unreadable'").count() == 3


def test_bad_rows_are_kept_apart(spark):
    lines = [FULL, *BAD, '{"bucket": "cut', "[1]", '"text"', "5", "null"]
    parsed = snapshots.parse_documents(texts(spark, *lines))
    assert snapshots.good_documents(parsed).count() == 1
    reasons = snapshots.quarantine(parsed).groupBy("reason").count()
    assert dict(rows_of(reasons)) == {"unreadable": 6, "no entity name": 2}


def test_usage_rows(spark):
    rows = normalize.usage_rows(records(spark, FULL, *EDGES))
    got = {(r.bucket_name, r.storage_class): (r.size_bytes, r.num_objects) for r in rows.collect()}
    assert got == {
        ("full", "main"): (410041, 1),
        ("full", "multimeta"): (9, 2),
        ("odd usage", "a"): (3, 0),
        ("null measures", "a"): (0, 4),
        ("null measures", "b"): (0, 0),
    }


def test_export_round_trip(spark):
    """What was read is written again: same keys, same order, same values."""
    cur = records(spark, FULL, *EDGES)
    got = {n: json.loads(d) for n, d in rows_of(export.export_all(cur))}
    assert got["full"] == FULL and list(got["full"]) == list(FULL)
    blank = got["no usage"]
    assert list(blank) == list(FULL)
    assert blank["bucket_quota"] == {
        "enabled": False, "check_on_raw": False, "max_size": -1, "max_size_kb": 0, "max_objects": -1,
    }
    assert blank["explicit_placement"] == {"data_pool": "", "data_extra_pool": "", "index_pool": ""}
    again = records(spark, *got.values())
    assert sorted(rows_of(again.drop("usage"))) == sorted(
        rows_of(
            normalize.normalize(snapshots.good_documents(snapshots.parse_documents(
                texts(spark, *[d for _, d in rows_of(export.export_all(again))])))).drop("usage")
        )
    )


def test_export_defaults_for_nulls(make_cur):
    cur = make_cur({"bucket_name": "b", "bucket_id": "i", "collected_at": NOW}).withColumns(
        {c: F.lit(None).cast("string") for c in ["owner", "versioning", "index_type", "marker"]}
    )
    got = json.loads(export.export_one(cur, "b").first().document)
    assert (got["owner"], got["versioning"], got["index_type"], got["marker"]) == ("", "off", "Normal", "i")
    assert export.export_one(cur, "c").count() == 0
    assert export.export_text(cur, "c").first().document == "{}"
    pretty = export.export_text(cur, "b").first().document
    assert "\n" in pretty and json.loads(pretty) == got


def test_internal_record(make_cur):
    cur = make_cur({"bucket_name": "b", "collected_at": NOW})
    got = json.loads(normalize.to_internal_json(cur).first().record)
    assert len(got) == 32 and got["collected_at"] == NOW.isoformat() and got["usage"] == {}


def test_files_with_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps(d) for d in [FULL, *EDGES]) + "\n\n")
    (tmp_path / "b.json").write_text(json.dumps({"bucket": "other"}))
    lines = snapshots.read_lines(spark, str(tmp_path))
    got = normalize.normalize(snapshots.good_documents(snapshots.parse_documents(lines)))
    assert got.count() == len(EDGES) + 2
    assert got.filter("collected_at IS NULL").count() == 0


@pytest.mark.parametrize("indent", [None, 4])
def test_files_with_arrays(spark, tmp_path, indent):
    (tmp_path / "a.json").write_text(json.dumps([FULL, 7, "x", *EDGES], indent=indent))
    (tmp_path / "one.json").write_text(json.dumps({"bucket": "other"}, indent=indent))
    arrays = snapshots.read_arrays(spark, str(tmp_path))
    good = snapshots.good_documents(snapshots.parse_documents(arrays))
    assert good.count() == len(EDGES) + 2


@pytest.mark.parametrize("count", [0, 1, 2, 500])
def test_indented_arrays_are_split(spark, tmp_path, count):
    """The same documents as from the whole file, though read in many pieces."""
    documents = [{**FULL, "bucket": f"b{i}", "tags": [{"k": i}, [i]]} for i in range(count)]
    (tmp_path / "a.json").write_text(json.dumps(documents, indent=4) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = snapshots.read_pretty_arrays(spark, str(tmp_path))
        got = normalize.normalize(snapshots.good_documents(snapshots.parse_documents(lines)))
        names = sorted(r.bucket_name for r in got.collect())
        parts = lines.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert names == sorted(d["bucket"] for d in documents)
    if count == 500:
        assert parts > 8
        assert got.filter("size_bytes = 410050 AND num_objects = 3").count() == count


def test_one_entity(spark):
    parsed = snapshots.parse_documents(texts(spark, FULL, {**FULL, "tenant": "u"}, EDGES[0]))
    good = snapshots.good_documents(parsed)
    assert snapshots.one_entity(good, "full").count() == 2
    assert snapshots.one_entity(good, "full", "u").count() == 1


def test_inventory(spark, tmp_path):
    listing = ["a", {"bucket": "b"}, {"name": "c"}, {"bucket": "", "name": "d"}, {"x": 1}, 5, None,
               ["e"], {"name": ""}, "5", "a", True]
    (tmp_path / "list.json").write_text(json.dumps(listing, indent=2))
    got = inventory.read_inventory(spark, str(tmp_path)).orderBy("pos").select("bucket_name")
    assert [r[0] for r in rows_of(got)] == ["a", "b", "c", "d", "5", "a"]


@pytest.mark.parametrize("text", ['{"bucket": "a"}', "", "null", "[broken", '"a"'])
def test_inventory_that_is_no_list(spark, text):
    df = spark.createDataFrame([(text,)], "value string")
    assert inventory.inventory_names(df).count() == 0


def status(spark, function, *values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, value string")
    return [r[1:] for r in rows_of(function(df).orderBy("i"))]


def test_sync_json(spark):
    zones = [
        {"source_zone": "z1", "shards_behind": 2, "entries_behind": None},
        {"source_zone": "", "shards_behind": 1, "entries_behind": 10},
        {"shards_behind": None},
    ]
    values = [json.dumps(v) for v in [zones, [], {"shards_behind": 3}, [{"source_zone": "z"}], [5, *zones]]]
    assert status(spark, sync.sync_from_json, *values) == [
        ("behind", 3, 10, "z1"),
        ("synced", 0, 0, ""),
        ("synced", 0, 0, ""),
        ("synced", 0, 0, "z"),
        ("behind", 3, 10, "z1"),
    ]


def test_sync_text(spark):
    cases = {
        "3 shards behind": ("behind", 3, 0, ""),
        "1 shard behind": ("behind", 1, 0, ""),
        "0 shards behind": ("behind", 0, 0, ""),
        "12 ENTRIES   behind": ("behind", 0, 12, ""),
        "1 entry behind": ("synced", 0, 0, ""),
        "Source zone: abc": ("synced", 0, 0, "abc"),
        "all caught up": ("synced", 0, 0, ""),
        "in sync; 4 shards behind": ("synced", 4, 0, ""),
        "0 errors, in sync": ("error", 0, 0, ""),
        "5 shards behind\n7 entries behind\nsource zone  z-2 x\nERROR": ("error", 5, 7, "z-2"),
        "": ("synced", 0, 0, ""),
    }
    assert status(spark, sync.sync_from_text, *cases) == list(cases.values())


def test_sync_fetch(spark):
    cases = [
        (True, '[{"shards_behind": 1}]', "", ("behind", 1, 0, "")),
        (True, ' {"a": 1}', "", ("synced", 0, 0, "")),
        (True, "2 shards behind", "", ("behind", 2, 0, "")),
        (True, "[broken", "", ("unknown", 0, 0, "")),
        (True, '{"a": ', "", ("unknown", 0, 0, "")),
        (True, '[7, {"shards_behind": 1}]', "", ("behind", 1, 0, "")),
        (True, "", "no sync", ("synced", 0, 0, "")),
        (True, "in sync", "no sync", ("synced", 0, 0, "")),
        (False, "", "Zone is NOT IN A MULTISITE setup", ("not_multisite", 0, 0, "")),
        (False, "", "no sync", ("not_multisite", 0, 0, "")),
        (False, "3 shards behind", "timeout", ("unknown", 0, 0, "")),
    ]
    df = spark.createDataFrame(
        [(i, *c[:3]) for i, c in enumerate(cases)], "i int, ok boolean, stdout string, stderr string"
    )
    rows = sync.sync_resolved(df).orderBy("i")
    assert [r[1:] for r in rows_of(rows)] == [c[3] for c in cases]


def test_attach_sync(spark, make_cur):
    cur = make_cur(
        {"bucket_name": "a", "sync_status": "synced", "collected_at": NOW},
        {"bucket_name": "b", "sync_status": "synced", "collected_at": NOW},
    )
    schema = "bucket_name string, sync_status string, sync_behind_shards int, sync_behind_entries int, sync_source_zone string"
    new = spark.createDataFrame([("a", "behind", 1, 2, "z")], schema)
    got = sync.attach_sync(cur, new)
    assert got.columns == cur.columns
    picked = got.select("bucket_name", "sync_status", "sync_behind_entries", "sync_source_zone")
    assert sorted(rows_of(picked)) == [("a", "behind", 2, "z"), ("b", "synced", 0, "")]


def test_lags_past_the_int_range(spark):
    got = status(spark, sync.sync_from_text, "3000000000 shards behind", f"{2**70} entries behind", f"{'9' * 60} shards behind")
    assert [r[:3] for r in got] == [("behind", 3_000_000_000, 0), ("behind", 0, 2**63 - 1), ("behind", 2**63 - 1, 0)]
    zones = [{"source_zone": "z", "shards_behind": 2**62}] * 3
    assert status(spark, sync.sync_from_json, json.dumps(zones))[0][:2] == ("behind", 2**63 - 1)
