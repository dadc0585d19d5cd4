"""Current rows, history, usage per class: replace, append, evolve, repair."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import NOW, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.operators import listing, maintenance, summary, worklist
from usagelens.operators.normalize import history_rows
from usagelens.plans.refresh import StatsStore
from usagelens.schemas import CLASS_USAGE, CURRENT
from usagelens.sinks.history import append_history, read_history
from usagelens.sinks.keyed import KeyedTable


def table(tmp_path, **options) -> KeyedTable:
    return KeyedTable(str(tmp_path / "current"), CURRENT, ("bucket_name",), shards=4, **options)


def test_upsert_and_read(spark, make_cur, tmp_path):
    t = table(tmp_path)
    row = {"bucket_name": "test-bucket", "owner": "test-user", "num_objects": 100}
    t.upsert(spark, make_cur({**row, "size_bytes": 1024000, "collected_at": NOW}), 1)
    found = listing.entity_row(t.read(spark), "test-bucket").collect()
    assert [(r.owner, r.num_objects, r.size_bytes, r.collected_at) for r in found] == [
        ("test-user", 100, 1024000, NOW)
    ]
    assert listing.entity_row(t.read(spark), "other").count() == 0


def test_replace(spark, make_cur, tmp_path):
    t = table(tmp_path)
    for version, objects in [(1, 100), (2, 200)]:
        row = {"bucket_name": "b", "num_objects": objects, "collected_at": NOW}
        t.upsert(spark, make_cur(row), version)
    assert rows_of(t.read(spark).select("bucket_name", "num_objects")) == [("b", 200)]


def test_older_rows_do_not_replace_newer_ones(spark, make_cur, tmp_path):
    t = table(tmp_path)
    for version, (objects, age) in enumerate([(1, 0), (2, 60)], start=1):
        at = NOW - timedelta(seconds=age)
        t.upsert(spark, make_cur({"bucket_name": "b", "num_objects": objects, "collected_at": at}), version)
    assert rows_of(t.read(spark).select("num_objects")) == [(1,)]


def test_repeated_version_changes_nothing(spark, make_cur, tmp_path):
    t = table(tmp_path)
    t.upsert(spark, make_cur(*[{"bucket_name": f"b{i}", "num_objects": i, "collected_at": NOW} for i in range(20)]), 1)
    later = make_cur({"bucket_name": "b3", "num_objects": 33, "collected_at": NOW + timedelta(1)})
    t.upsert(spark, later, 2)
    once = sorted(rows_of(t.read(spark).select("bucket_name", "num_objects")))
    t.upsert(spark, later, 2)
    assert sorted(rows_of(t.read(spark).select("bucket_name", "num_objects"))) == once
    assert len(once) == 20 and ("b3", 33) in once


def test_uncommitted_version_is_invisible(spark, make_cur, tmp_path):
    """A job that died before its commit leaves the table as it was."""
    t = table(tmp_path)
    t.upsert(spark, make_cur({"bucket_name": "b", "num_objects": 1, "collected_at": NOW}), 1)
    half = make_cur({"bucket_name": "b", "num_objects": 9, "collected_at": NOW}).withColumn("shard", F.lit(0))
    half.write.partitionBy("shard").parquet(f"{t.root}/data/version=2")
    assert rows_of(t.read(spark).select("num_objects")) == [(1,)]


def test_only_touched_shards_are_rewritten(spark, make_cur, tmp_path):
    t = table(tmp_path)
    t.upsert(spark, make_cur(*[{"bucket_name": f"b{i}", "collected_at": NOW} for i in range(40)]), 1)
    t.upsert(spark, make_cur({"bucket_name": "b7", "collected_at": NOW + timedelta(1)}), 2)
    first = {p.name for p in (tmp_path / "current/data/version=1").glob("shard=*")}
    second = {p.name for p in (tmp_path / "current/data/version=2").glob("shard=*")}
    assert len(first) == 4 and len(second) == 1
    assert t.read(spark).count() == 40


def test_shard_count_is_fixed(spark, make_cur, tmp_path):
    table(tmp_path).upsert(spark, make_cur({"bucket_name": "b", "collected_at": NOW}), 1)
    other = KeyedTable(str(tmp_path / "current"), CURRENT, ("bucket_name",), shards=8)
    with pytest.raises(ValueError):
        other.read(spark)


def test_unknown_status_keeps_the_known_one(spark, make_cur, tmp_path):
    t = table(tmp_path, carry=("sync_status", "sync_behind_shards"))
    known = {"bucket_name": "b", "sync_status": "behind", "sync_behind_shards": 4, "collected_at": NOW}
    t.upsert(spark, make_cur(known), 1)
    unknown = {"bucket_name": "b", "num_objects": 5, "collected_at": NOW + timedelta(1)}
    later = make_cur(unknown).withColumns(
        {"sync_status": F.lit(None).cast("string"), "sync_behind_shards": F.lit(None).cast("int")}
    )
    t.upsert(spark, later, 2)
    got = t.read(spark).select("num_objects", "sync_status", "sync_behind_shards")
    assert rows_of(got) == [(5, "behind", 4)]


def test_files_of_an_earlier_release_get_defaults(spark, make_cur, tmp_path):
    store = StatsStore(str(tmp_path), shards=4)
    t = store.current
    old = KeyedTable(
        t.root,
        type(CURRENT)([f for f in CURRENT.fields if f.name not in ("marker", "versioned", "usage")]),
        ("bucket_name",),
        shards=4,
    )
    old.upsert(spark, make_cur({"bucket_name": "b", "owner": "o", "collected_at": NOW}), 1)
    got = t.read(spark).select("owner", "marker", "versioned", "usage")
    assert rows_of(got) == [("o", "", False, {})]


def test_conform_adds_typed_defaults(spark):
    df = spark.createDataFrame([("b",)], "bucket_name string")
    row = maintenance.conform(df, CURRENT).first()
    assert (row.marker, row.versioned, row.size_bytes, row.usage, row.collected_at) == (
        "", False, 0, {}, None,
    )
    assert maintenance.conform(df, CURRENT).schema.names == CURRENT.names


def test_vanished_classes_linger(spark, tmp_path):
    t = KeyedTable(str(tmp_path / "u"), CLASS_USAGE, ("bucket_name", "storage_class"), shards=4)

    def usage(*classes, at):
        return spark.createDataFrame([("b", c, s, s, s, 1, at) for c, s in classes], CLASS_USAGE)

    t.upsert(spark, usage(("hot", 1), ("cold", 2), at=NOW), 1)
    t.upsert(spark, usage(("hot", 7), at=NOW + timedelta(1)), 2)
    got = sorted(rows_of(t.read(spark).select("storage_class", "size_bytes")))
    assert got == [("cold", 2), ("hot", 7)]


def test_history_append_is_repeatable(spark, make_cur, tmp_path):
    path = str(tmp_path / "h")
    assert read_history(spark, path).count() == 0
    day1 = make_cur({"bucket_name": "b", "size_bytes": 1, "collected_at": NOW})
    day2 = make_cur({"bucket_name": "b", "size_bytes": 2, "collected_at": NOW + timedelta(days=1)})
    append_history(history_rows(day1), path, 1)
    append_history(history_rows(day1.unionByName(day2)), path, 2)
    append_history(history_rows(day1.unionByName(day2)), path, 2)
    got = read_history(spark, path).groupBy("collected_date").count().orderBy("collected_date")
    assert [r["count"] for r in got.collect()] == [2, 1]
    # the same version with other days leaves nothing of the first attempt
    append_history(history_rows(day2), path, 2)
    got = read_history(spark, path).groupBy("collected_date").count().orderBy("collected_date")
    assert [r["count"] for r in got.collect()] == [1, 1]
    assert read_history(spark, path, upto=1).count() == 1


def test_a_large_day_is_written_by_many_tasks(spark, tmp_path):
    """All rows fall on one day; the day is split by size, not sent to one task."""
    rows = spark.range(0, 200_000, 1, 8).select(
        F.col("id"),
        F.concat(F.lit("b"), F.xxhash64("id")).alias("bucket_name"),
        F.xxhash64("id", F.lit(1)).alias("size_bytes"),
        F.lit(1).cast("bigint").alias("num_objects"),
        F.lit(0).alias("sync_behind_shards"),
        F.lit(0).alias("sync_behind_entries"),
        F.lit(str(NOW)).cast("timestamp_ntz").alias("collected_at"),
    )
    path = str(tmp_path / "h")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        append_history(rows, path, 1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "h").glob("*/*/*.parquet"))
    assert len(files) > 3
    assert read_history(spark, path).agg(F.count("id"), F.countDistinct("id")).first()[:] == (200_000, 200_000)


def test_stale(make_cur):
    cur = make_cur(
        {"bucket_name": "old-bucket", "collected_at": NOW - timedelta(minutes=10)},
        {"bucket_name": "new-bucket", "collected_at": NOW},
        {"bucket_name": "never", "collected_at": None},
    )
    assert rows_of(listing.stale_for_refresh(cur, NOW, 300)) == [("never",), ("old-bucket",)]
    assert rows_of(listing.stale_for_refresh(cur, NOW, 300, limit=1)) == [("never",)]
    # the report leaves rows without a time out, the count does not
    assert [r[0] for r in rows_of(listing.stale_report(cur, NOW, 5))] == ["old-bucket"]
    assert rows_of(summary.stale_count(cur, NOW, 300)) == [(300, 2)]


def test_repair(make_cur):
    cur = make_cur({"bucket_name": "a", "collected_at": None}, {"bucket_name": "b", "collected_at": NOW})
    assert rows_of(maintenance.repair_dry_run(cur)) == [(1,)]
    fixed = maintenance.repair_null_times(cur, NOW + timedelta(1))
    assert dict(rows_of(fixed.select("bucket_name", "collected_at"))) == {
        "a": NOW + timedelta(1), "b": NOW,
    }
    assert rows_of(maintenance.repair_dry_run(fixed)) == [(0,)]


def test_uncollected(spark, make_cur):
    names = ["existing-bucket", "new-bucket-1", "new-bucket-2", "new-bucket-1"]
    inv = spark.createDataFrame(list(enumerate(names)), "pos int, bucket_name string")
    cur = make_cur({"bucket_name": "existing-bucket", "collected_at": NOW})
    got = [r[0] for r in rows_of(worklist.uncollected(inv, cur))]
    assert got == ["new-bucket-1", "new-bucket-2", "new-bucket-1"]
    assert worklist.uncollected(inv, cur, limit=1).count() == 1
    assert worklist.uncollected(inv.limit(0), cur).count() == 0


def test_worklist_order(spark, make_cur):
    inv = spark.createDataFrame([(0, "z"), (1, "a"), (2, "z"), (3, "old")], "pos int, bucket_name string")
    cur = make_cur(
        {"bucket_name": "old", "collected_at": NOW - timedelta(1)},
        {"bucket_name": "older", "collected_at": NOW - timedelta(2)},
        {"bucket_name": "fresh", "collected_at": NOW},
    )
    got = worklist.refresh_worklist(inv, cur, NOW)
    assert rows_of(got) == [
        ("z", "uncollected"), ("a", "uncollected"), ("older", "stale"), ("old", "stale"),
    ]
    prioritised = worklist.refresh_worklist_prioritised(inv, cur, NOW, limit=4)
    assert rows_of(prioritised) == [("z", 0), ("a", 0), ("z", 0), ("older", 1)]


@pytest.mark.parametrize(("threshold", "mode"), [(500, "per-bucket"), (1, "bulk")])
def test_refresh_plan(spark, make_cur, threshold, mode):
    inv = spark.createDataFrame([(0, "a"), (1, "new"), (2, "new")], "pos int, bucket_name string")
    cur = make_cur(
        {"bucket_name": "a", "collected_at": NOW},
        {"bucket_name": "gone", "collected_at": None},
    )
    plan = worklist.refresh_plan(inv, cur, NOW, bulk_threshold=threshold)
    assert rows_of(plan) == [(3, 2, 2, 1, 3, 1, mode)]


def test_refresh_plan_with_nothing_to_do(spark, make_cur):
    inv = spark.createDataFrame([(0, "a")], "pos int, bucket_name string")
    cur = make_cur({"bucket_name": "a", "collected_at": NOW})
    assert rows_of(worklist.refresh_plan(inv, cur, NOW)) == [(1, 1, 0, 0, 0, 0, "none")]


_ROWS = st.lists(
    st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.one_of(st.none(), st.sampled_from("xy"))),
    min_size=1,
    max_size=12,
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=_ROWS, cut=st.integers(0, 12), swap=st.booleans())
def test_merge_is_order_independent_and_repeatable(spark, rows, cut, swap):
    schema = "k string, t int, s string, id int, v int"
    full = [(k, t, s, i, i * 10) for i, (k, t, s) in enumerate(rows)]
    expected = {}
    for k in {r[0] for r in full}:
        mine = sorted((r for r in full if r[0] == k), key=lambda r: (r[1], r[3]))
        status = [r[2] for r in mine if r[2] is not None]
        expected[k] = (mine[-1][1], status[-1] if status else None, mine[-1][3], mine[-1][4])
    parts = [full[:cut], full[cut:]]
    if swap:
        parts.reverse()
    left, right = (spark.createDataFrame(part, schema) for part in parts)
    # a status travels with the time of the row that knew it only within one reduction, so
    # the parts are merged as they are
    merged = maintenance.merge_latest(left, right, ["k"], ["t", "id"], ["s"])
    assert {r.k: (r.t, r.s, r.id, r.v) for r in merged.collect()} == expected
    again = maintenance.merge_latest(merged, merged, ["k"], ["t", "id"], ["s"])
    assert {r.k: (r.t, r.s, r.id, r.v) for r in again.collect()} == expected


def test_hot_entity_is_reduced_before_the_shuffle(spark):
    """One entity holds most rows: each task hands over one row for it."""
    rows = spark.range(0, 40_000, 1, 8).select(
        F.when(F.col("id") % 4 > 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("bucket_name"),
        F.col("id").alias("size_bytes"),
        F.col("id").alias("order"),
    )
    latest = maintenance.latest_per_key(rows, ["bucket_name"], ["order"])
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan
    got = dict(rows_of(latest.select("bucket_name", "size_bytes")))
    assert got["hot"] == 39_999 and len(got) == 26


def test_total_past_long_range(spark):
    from usagelens.functions.measures import WIDE, total

    big = 2**62
    df = spark.createDataFrame([(big,), (big,), (big,), (-5,), (None,), (7,)], "x bigint")
    assert df.agg(total("x", WIDE).alias("t")).first().t == 3 * big + 2
    assert df.limit(0).agg(total("x", WIDE).alias("t")).first().t == 0
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        df.agg(total("x").alias("t")).collect()


def test_naive_times_do_not_depend_on_the_session_zone(spark, make_hist):
    from usagelens.operators.growth import cluster_growth

    hist = make_hist(("b", datetime(2024, 3, 31, 2, 30), 1, 1), ("b", datetime(2024, 3, 31, 23, 59), 2, 1))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = rows_of(cluster_growth(hist, datetime(2024, 4, 1)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(datetime(2024, 3, 31), 3, 2)]


def test_old_versions_are_dropped(spark, make_cur, tmp_path):
    t = table(tmp_path)
    t.upsert(spark, make_cur(*[{"bucket_name": f"b{i}", "collected_at": NOW} for i in range(40)]), 1)
    for version in range(2, 7):
        row = {"bucket_name": "b7", "num_objects": version, "collected_at": NOW + timedelta(version)}
        t.upsert(spark, make_cur(row), version)
    before = sorted(rows_of(t.read(spark).select("bucket_name", "num_objects")))
    t.drop_old(spark, keep=2)
    assert sorted(rows_of(t.read(spark).select("bucket_name", "num_objects"))) == before
    shards = {p.parent.name + "/" + p.name for p in (tmp_path / "current/data").glob("*/shard=*")}
    # three shards still live in the first version, the hot one in the two newest
    assert len([s for s in shards if s.startswith("version=1/")]) == 3
    assert sorted(s.split("/")[0] for s in shards if "=1/" not in s) == ["version=5", "version=6"]
    assert len(list((tmp_path / "current/commits").glob("version=*"))) == 2


def test_compacted_history_is_the_same(spark, make_cur, tmp_path):
    path, target = str(tmp_path / "h"), str(tmp_path / "compact")
    for version in range(1, 4):
        rows = make_cur(*[{"bucket_name": f"b{i}", "size_bytes": version, "collected_at": NOW} for i in range(3)])
        append_history(history_rows(rows), path, version)
    from usagelens.sinks.history import compact_history

    # a fourth append of a run that did not finish
    append_history(history_rows(rows), path, 4)
    compact_history(spark, path, target, upto=3)
    assert sorted(rows_of(read_history(spark, target))) == sorted(rows_of(read_history(spark, path, 3)))
    assert len(list((tmp_path / "compact").glob("*/*/*.parquet"))) == 1


def _rows_read(frame):
    """Rows that came out of the frame's file scans."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.nodeName().startswith("Adaptive"):
        plan = plan.executedPlan()
    leaves, rows = plan.collectLeaves(), 0
    for k in range(leaves.size()):
        rows += leaves.apply(k).metrics().apply("numOutputRows").value()
    return rows


def test_lookups_read_row_groups_that_may_hold_the_name(spark, tmp_path):
    """Names between the least and the greatest of every file, but in none or one of them."""
    table = KeyedTable(str(tmp_path / "t"), CURRENT, ("bucket_name",), shards=4)
    rows = spark.range(4000).select(F.format_string("b%05d", F.col("id") * 2).alias("bucket_name"), F.lit(NOW).alias("collected_at"))
    table.upsert(spark, maintenance.conform(rows, CURRENT), 1)
    assert _rows_read(table.read(spark).select("bucket_name")) == 4000
    assert _rows_read(table.read(spark).filter("bucket_name = 'b00101'")) == 0
    found = table.read(spark).filter("bucket_name = 'b00100'")
    assert [r.bucket_name for r in found.collect()] == ["b00100"] and _rows_read(found) < 2000
