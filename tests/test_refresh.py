"""Landing files through to tables, serving snapshot and reports; batch and stream."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta, timezone

import pytest
from conftest import NOW, rows_of
from pyspark.sql import functions as F

from usagelens.lens import Lens
from usagelens.operators import listing, summary, worklist
from usagelens.plans import duty, refresh, serving
from usagelens.sinks import versions
from usagelens.sources import snapshots
from usagelens.streaming.refresh import feeds, refresh_feeds, refresh_folder, stream_id

STALE = 60


def document(name: str, size: int = 1024) -> dict:
    usage = {"main": {"size": size, "size_actual": size, "num_objects": len(name)}}
    return {"bucket": name, "owner": f"user-{sum(map(ord, name)) % 10}", "id": f"id-{name}", "usage": usage}


def documents(spark, names, at, size=1024):
    rows = [(json.dumps(document(n, size)), at) for n in names]
    return spark.createDataFrame(rows, "value string, collected_at timestamp_ntz")


def inventory(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "pos int, bucket_name string")


@pytest.fixture
def store(tmp_path):
    return refresh.StatsStore(str(tmp_path / "store"), shards=4)


def collect(spark, store, names, now, limit=None):
    """One cycle: plan, collect what is due, return how much was collected."""
    cur, inv = store.current.read(spark), inventory(spark, names)
    due = worklist.refresh_worklist(inv, cur, now, STALE, limit)
    if due.isEmpty():
        return 0
    # the admin tool is asked for the names on the list
    fetched = documents(spark, [r.bucket_name for r in due.collect()], now)
    return refresh.incremental_refresh(spark, store, fetched, due).first().collected


def test_collection_cycles(spark, store):
    names = [f"test-bucket-{i:04d}" for i in range(50)]
    assert collect(spark, store, names, NOW, limit=10) == 10
    assert store.current.read(spark).count() == 10
    assert collect(spark, store, names, NOW) == 40
    assert collect(spark, store, names, NOW) == 0
    old = documents(spark, names[:1], NOW - timedelta(minutes=10))
    other = refresh.StatsStore(store.root + "-2", shards=4)
    refresh.bulk_refresh(spark, other, documents(spark, names[1:], NOW).unionByName(old))
    assert collect(spark, other, names, NOW) == 1
    assert collect(spark, other, names, NOW) == 0


def test_planned_cycles(spark, store):
    names = [f"b{i}" for i in range(20)]
    inv = inventory(spark, names)

    def cycle(now, **options):
        fetched = documents(spark, names, now)
        return refresh.refresh_once(spark, store, inv, fetched, now, STALE, **options).first()

    first = cycle(NOW, bulk_threshold=10)
    assert (first.mode, first.collected, first.to_update, first.in_db) == ("bulk", 20, 20, 0)
    idle = cycle(NOW)
    assert (idle.mode, idle.collected, idle.in_db) == ("none", 0, 20)
    later = NOW + timedelta(minutes=10)
    some = cycle(later, limit=5)
    assert (some.mode, some.collected, some.to_update) == ("per-bucket", 5, 20)
    rest = cycle(later)
    assert (rest.mode, rest.collected, rest.to_update) == ("per-bucket", 15, 15)
    assert cycle(later).mode == "none"
    assert store.tables(spark).hist.count() == 40


def test_workflow(spark, store):
    names = [f"project-a-bucket-{i}" for i in range(30)] + [f"project-b-bucket-{i}" for i in range(20)]
    counters = refresh.bulk_refresh(spark, store, documents(spark, names, NOW)).first()
    assert counters.asDict() == {"fetched": 50, "collected": 50, "errors": 0, "mode": "bulk"}
    tables = store.tables(spark, inventory(spark, names))
    lens = Lens(tables, NOW)
    assert lens.cluster_summary().first().total_buckets == 50
    assert lens.top_by_size(5).count() == 5
    assert sum(r.bucket_count for r in lens.summary_by_owner().collect()) == 50
    assert rows_of(lens.storage_class_distribution())[0][:2] == ("main", 50)
    assert lens.refresh_plan().first().mode == "none"
    assert lens.entity_details("project-a-bucket-3").first().storage_classes == ["main"]
    assert lens.entity_history("project-a-bucket-3").count() == 1
    assert lens.sql("SELECT count(*) AS n FROM bucket_stats_history").first().n == 50
    state = refresh.run_state(spark, store).first()
    assert (state.total_collected, state.cycles_completed, state.last_cycle_buckets) == (50, 1, 50)
    assert state.collection_rate == pytest.approx(50 / state.last_cycle_time)


def test_bulk_counts_errors_and_keeps_the_rest(spark, store):
    good = documents(spark, ["a", "b"], NOW)
    bad = spark.createDataFrame(
        [('{"bucket": "c", "num_shards": "x"}', NOW), ('{"owner": "o"}', NOW), ("{broken", NOW)],
        good.schema,
    )
    counters = refresh.bulk_refresh(spark, store, good.unionByName(bad)).first()
    assert (counters.fetched, counters.collected, counters.errors) == (3, 2, 1)
    assert store.current.read(spark).count() == 2


def test_bulk_with_nothing(spark, store):
    counters = refresh.bulk_refresh(spark, store, documents(spark, ["a"], NOW).limit(0)).first()
    assert (counters.fetched, counters.collected, counters.errors) == (0, 0, 0)
    assert store.current.read(spark).count() == 0


def test_entities_without_usage(spark, store):
    """Their shard has current rows but no usage rows."""
    empty = [(json.dumps({"bucket": f"e{i}", "usage": {}}), NOW) for i in range(3)]
    docs = spark.createDataFrame(empty, "value string, collected_at timestamp_ntz")
    refresh.bulk_refresh(spark, store, docs)
    assert store.current.read(spark).count() == 3
    assert store.usage.read(spark).count() == 0
    refresh.bulk_refresh(spark, store, documents(spark, ["a"], NOW).unionByName(docs))
    assert store.current.read(spark).count() == 4
    assert rows_of(store.usage.read(spark).select("bucket_name")) == [("a",)]


def test_sync_status_survives_a_refresh_without_it(spark, store):
    schema = "bucket_name string, sync_status string, sync_behind_shards int, sync_behind_entries int, sync_source_zone string"
    status = spark.createDataFrame([("a", "behind", 3, 4, "z")], schema)
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW), sync=status)
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW + timedelta(1), size=5))
    got = store.current.read(spark).select("bucket_name", "size_bytes", "sync_status", "sync_behind_shards")
    assert sorted(rows_of(got)) == [("a", 5, "behind", 3), ("b", 5, None, None)]


def test_incremental_equals_bulk(spark, store):
    names = [f"b{i}" for i in range(12)]
    later = documents(spark, names, NOW + timedelta(1), size=9)
    refresh.bulk_refresh(spark, store, documents(spark, names, NOW))
    for part in (names[:5], names[5:]):
        refresh.incremental_refresh(spark, store, later, inventory(spark, part))
    whole = refresh.StatsStore(store.root + "-2", shards=4)
    refresh.bulk_refresh(spark, whole, documents(spark, names, NOW))
    refresh.bulk_refresh(spark, whole, later)
    for pick in [lambda s: s.current.read(spark), lambda s: s.usage.read(spark)]:
        assert sorted(map(str, rows_of(pick(store)))) == sorted(map(str, rows_of(pick(whole))))


def test_serving(spark, make_cur, tmp_path):
    root = str(tmp_path / "serving")
    assert serving.read_section(spark, root, "summary") is None
    assert serving.serving_age(spark, root, NOW) is None
    cur = make_cur(
        *[
            {"bucket_name": f"b{i}", "owner": "o", "size_bytes": i, "sync_status": "synced", "collected_at": NOW}
            for i in range(5)
        ]
    )
    serving.publish_serving(cur.limit(0), root, 1, NOW - timedelta(seconds=30))
    serving.publish_serving(cur, root, 2, NOW - timedelta(seconds=10))
    assert serving.serving_age(spark, root, NOW).first().age_seconds == 10.0
    top = serving.read_section(spark, root, "top_by_size", 2)
    assert [(r.bucket_name, r.size_bytes) for r in top.collect()] == [("b4", 4), ("b3", 3)]
    everything = serving.read_section(spark, root, "all_buckets")
    assert [r.bucket_name for r in everything.collect()] == [f"b{i}" for i in range(5)]
    row = serving.read_section(spark, root, "summary").first()
    assert (row.total_buckets, row.oldest_collection) == (5, str(NOW))
    assert rows_of(serving.read_section(spark, root, "sync_summary")) == [("synced", 5)]
    assert rows_of(serving.read_section(spark, root, "freshness")) == [("fresh_10m", 5)]
    # a version without a commit is not seen
    serving.serving_snapshot(cur.limit(1), NOW).write.partitionBy("section").parquet(
        versions.data_path(root, 3)
    )
    assert serving.read_section(spark, root, "summary").first().total_buckets == 5


def _land(folder, name, docs, mtime):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in docs))
    os.utime(path, (mtime, mtime))


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    _land(landing, "1.json", [document(f"b{i}", 10) for i in range(8)], 1_700_000_000)
    _land(landing, "2.json", [document(f"b{i}", 20) for i in range(4)] + ["{broken"], 1_700_000_300)
    streamed = refresh.StatsStore(str(tmp_path / "streamed"), shards=4)
    served = str(tmp_path / "serving")

    def run():
        query = refresh_folder(
            spark, str(landing), streamed, str(tmp_path / "checkpoint"), files_per_trigger=1,
            serving_root=served, as_of=NOW, once=True,
        )
        query.awaitTermination()

    run()
    assert refresh.run_state(spark, streamed).first().cycles_completed == 2
    # restarted from its checkpoint, it takes only what is new
    _land(landing, "3.json", [document("b7", 30), document("late", 1)], 1_700_000_600)
    run()
    state = refresh.run_state(spark, streamed).first()
    assert (state.cycles_completed, state.total_collected, state.total_errors) == (3, 14, 0)
    batch = refresh.StatsStore(str(tmp_path / "batch"), shards=4)
    refresh.bulk_refresh(spark, batch, snapshots.read_lines(spark, str(landing)))

    for pick in [
        lambda t: t.cur,
        lambda t: t.usage,
        lambda t: t.hist.select("bucket_name", "size_bytes", "collected_at"),
    ]:
        left, right = pick(streamed.tables(spark)), pick(batch.tables(spark))
        assert sorted(map(str, rows_of(left))) == sorted(map(str, rows_of(right)))
    assert streamed.tables(spark).hist.count() == 14
    newest = serving.read_section(spark, served, "summary").first()
    assert (newest.total_buckets, newest.total_size_bytes) == (9, 4 * 20 + 3 * 10 + 30 + 1)


def test_replayed_batch_changes_nothing(spark, store):
    first = documents(spark, ["a", "b"], NOW)
    second = documents(spark, ["b", "c"], NOW + timedelta(1), size=7)
    refresh.load_documents(spark, store, first, 1)
    refresh.load_documents(spark, store, second, 2)
    before = sorted(map(str, rows_of(store.current.read(spark))))
    count = store.tables(spark).hist.count()
    refresh.load_documents(spark, store, second, 2)
    assert sorted(map(str, rows_of(store.current.read(spark)))) == before
    assert store.tables(spark).hist.count() == count == 4


def test_run_that_died_half_way_is_repeated(spark, store, monkeypatch):
    refresh.load_documents(spark, store, documents(spark, ["a"], NOW), 1)
    second = documents(spark, ["a", "b"], NOW + timedelta(1), size=7)

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        # all tables are written, the run is not committed
        patch.setattr(refresh, "_finish_run", lost)
        with pytest.raises(RuntimeError):
            refresh.load_documents(spark, store, second, 2)
    assert store.next_version(spark) == 2
    # what the lost run has written is not seen
    seen = store.tables(spark)
    assert (seen.hist.count(), seen.cur.count()) == (1, 1)
    assert seen.usage.filter("size_bytes = 7").count() == 0
    refresh.load_documents(spark, store, second, 2)
    got = store.current.read(spark).select("bucket_name", "size_bytes")
    assert sorted(rows_of(got)) == [("a", 7), ("b", 7)]
    assert store.tables(spark).hist.count() == 3


@pytest.mark.parametrize("after", ["repair", "empty run", "run without history"])
def test_dead_run_leaves_no_rows(spark, store, monkeypatch, after):
    refresh.load_documents(spark, store, documents(spark, ["a"], NOW), 1)

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as patch:
        patch.setattr(refresh, "_finish_run", lost)
        with pytest.raises(RuntimeError):
            refresh.load_documents(spark, store, documents(spark, ["ghost", "a"], NOW + timedelta(1), 7), 2)
    if after == "repair":
        refresh.repair(spark, store, NOW)
    elif after == "empty run":
        refresh.load_documents(spark, store, documents(spark, ["a"], NOW).limit(0), 2)
    else:
        refresh.load_documents(spark, store, documents(spark, ["a"], NOW), 2, save_history=False)
    seen = store.tables(spark)
    assert store.last_version(spark) == 2
    assert rows_of(seen.cur.select("bucket_name", "size_bytes")) == [("a", 1024)]
    assert rows_of(seen.usage.select("bucket_name", "size_bytes")) == [("a", 1024)]
    assert rows_of(seen.hist.select("bucket_name", "size_bytes")) == [("a", 1024)]


def test_new_checkpoint_at_an_old_place_is_another_stream(spark, store, tmp_path):
    first, second, checkpoint = tmp_path / "first", tmp_path / "second", tmp_path / "checkpoint"
    _land(first, "1.json", [document("a", 1)], 1_800_000_000)
    refresh_folder(spark, str(first), store, str(checkpoint), once=True).awaitTermination()
    checkpoint.rename(tmp_path / "retired")
    _land(second, "2.json", [document("b", 2)], 1_800_000_001)
    refresh_folder(spark, str(second), store, str(checkpoint), once=True).awaitTermination()
    got = store.current.read(spark).select("bucket_name", "size_bytes")
    assert sorted(rows_of(got)) == [("a", 1), ("b", 2)]


def test_replication_status_is_one_reading(spark, store):
    def status(*values):
        ddl = "bucket_name string, sync_status string, sync_behind_shards int, sync_behind_entries int, sync_source_zone string"
        return spark.createDataFrame([("a", *values)], ddl)

    names = ["sync_status", "sync_behind_shards", "sync_behind_entries", "sync_source_zone"]
    refresh.bulk_refresh(spark, store, documents(spark, ["a"], NOW), sync=status("behind", 3, 7, "east"))
    later = documents(spark, ["a"], NOW + timedelta(1))
    refresh.bulk_refresh(spark, store, later, sync=status("synced", 0, None, None))
    refresh.bulk_refresh(spark, store, documents(spark, ["a"], NOW + timedelta(2)))
    assert rows_of(store.current.read(spark).select(*names)) == [("synced", 0, None, None)]


def test_stream_after_bulk_keeps_what_is_there(spark, store, tmp_path):
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW))
    landing, checkpoint = tmp_path / "landing", str(tmp_path / "checkpoint")
    _land(landing, "1.json", [document("b", 9), document("c", 9)], 1_800_000_000)
    refresh_folder(spark, str(landing), store, checkpoint, once=True).awaitTermination()
    refresh.bulk_refresh(spark, store, documents(spark, ["d"], NOW))
    assert store.last_batch(spark, stream_id(spark, checkpoint)) == 0
    assert store.last_batch(spark, "other") == -1
    got = store.current.read(spark).select("bucket_name", "size_bytes")
    assert sorted(rows_of(got)) == [("a", 1024), ("b", 9), ("c", 9), ("d", 1024)]
    assert store.tables(spark).hist.count() == 5


def test_batch_replayed_after_its_commit_is_not_applied_again(spark, store, tmp_path):
    """The checkpoint lost the note that the batch was done; the tables have not."""
    landing, checkpoint = tmp_path / "landing", tmp_path / "checkpoint"
    _land(landing, "1.json", [document("b", 9)], 1_800_000_000)
    refresh_folder(spark, str(landing), store, str(checkpoint), once=True).awaitTermination()
    for note in (checkpoint / "commits").iterdir():
        note.unlink()
    refresh_folder(spark, str(landing), store, str(checkpoint), once=True).awaitTermination()
    state = refresh.run_state(spark, store).first()
    assert (state.cycles_completed, state.total_collected) == (1, 1)
    assert store.tables(spark).hist.count() == 1


@pytest.mark.parametrize("form", ["lines", "array", "indented array"])
def test_last_document_of_a_file_wins(spark, store, tmp_path, form):
    docs = [document(f"b{i % 7}", i) for i in range(300)]
    text = {
        "lines": "\n".join(map(json.dumps, docs)),
        "array": json.dumps(docs),
        "indented array": json.dumps(docs, indent=4),
    }[form]
    read = {
        "lines": snapshots.read_lines,
        "array": snapshots.read_arrays,
        "indented array": snapshots.read_pretty_arrays,
    }[form]
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.json").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        landed = read(spark, str(tmp_path / "landing"))
        refresh.bulk_refresh(spark, store, landed)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = dict(rows_of(store.current.read(spark).select("bucket_name", "size_bytes")))
    assert got == {f"b{i % 7}": i for i in range(300)}
    assert store.tables(spark).hist.count() == 300
    usage = store.tables(spark).usage
    assert rows_of(summary.storage_class_distribution(usage)) == rows_of(
        summary.storage_class_distribution(usage, unique=True)
    )


def test_repair_of_the_stored_table(spark, store):
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW))
    untimed = documents(spark, ["c"], NOW).withColumn("collected_at", F.lit(None).cast("timestamp_ntz"))
    refresh.bulk_refresh(spark, store, untimed)
    assert rows_of(summary.timestamp_health(store.tables(spark).cur))[0][:2] == (3, 1)
    assert refresh.repair(spark, store, NOW + timedelta(1)).first().fetched == 1
    got = store.tables(spark).cur.select("bucket_name", "collected_at", "size_bytes")
    assert sorted(rows_of(got)) == [("a", NOW, 1024), ("b", NOW, 1024), ("c", NOW + timedelta(1), 1024)]
    state = refresh.run_state(spark, store).first()
    assert (state.cycles_completed, state.total_collected) == (2, 3)
    assert refresh.repair(spark, store, NOW).first().fetched == 0


def test_no_runs_yet(spark, store):
    assert refresh.run_state(spark, store).count() == 0
    assert store.next_version(spark) == 1
    assert store.tables(spark).cur.count() == 0


def test_clean_up_keeps_the_rows(spark, store):
    for i in range(4):
        refresh.bulk_refresh(spark, store, documents(spark, [f"b{i}", "hot"], NOW + timedelta(i)))
    before = {n: getattr(store.tables(spark), n).count() for n in ("cur", "hist", "usage")}
    store.drop_old(spark, keep=1)
    assert {n: getattr(store.tables(spark), n).count() for n in before} == before
    assert refresh.run_state(spark, store).first().total_collected == 8
    assert store.next_version(spark) == 5


def test_stale_rows_after_a_run(spark, store):
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW))
    cur = store.current.read(spark)
    assert listing.stale_for_refresh(cur, NOW, STALE).count() == 0
    later = NOW + timedelta(seconds=STALE + 1)
    assert listing.stale_for_refresh(cur, later, STALE).count() == 2
    assert summary.stale_count(cur, later, STALE).first().stale_count == 2
    assert cur.filter(F.col("usage").isNull()).count() == 0


def test_landed_documents_always_apply(spark, store):
    """Of three landed documents one is due; the new size of another and a new entity stay."""
    refresh.bulk_refresh(spark, store, documents(spark, ["a", "b"], NOW))
    inv, later = inventory(spark, ["a", "b", "c"]), NOW + timedelta(seconds=STALE // 2)
    landed = documents(spark, ["a", "c", "d"], later, size=7)
    row = refresh.refresh_once(spark, store, inv, landed, later, STALE, landed=True).first()
    assert (row.mode, row.fetched, row.collected, row.to_update) == ("per-bucket", 3, 3, 1)
    got = dict(rows_of(store.tables(spark).cur.select("bucket_name", "size_bytes")))
    assert got == {"a": 7, "b": 1024, "c": 7, "d": 7}


def test_metrics_cover_every_row(spark, store):
    good = documents(spark, ["a", "b", "c"], NOW)
    odd = ['{"bucket": "d", "num_shards": "x"}', '{"owner": "o"}', "{broken", '{"bucket": "a", "bucket": "b"}']
    bad = spark.createDataFrame([(t, NOW) for t in odd], good.schema)
    landed = good.unionByName(bad)
    refresh.bulk_refresh(spark, store, landed)
    refresh.incremental_refresh(spark, store, landed, inventory(spark, ["a", "a", "d"]))
    rows = refresh.run_metrics(spark, store).orderBy("version").collect()
    assert [(r.landed, r.collected, r.errors, r.unreadable, r.nameless, r.skipped) for r in rows] == [
        (7, 4, 3, 2, 1, 0),
        (7, 1, 3, 2, 1, 3),
    ]
    assert all(r.landed == r.collected + r.errors + r.skipped for r in rows)


def test_listed_names_meet_documents_before_the_parse(spark):
    docs = documents(spark, ["a", "b"], NOW)
    plan = snapshots.parse_documents(refresh._on_list(docs, inventory(spark, ["a"])))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("inline(array(from_json") < text.index("LeftSemi")


def test_history_ids_tell_documents_apart(spark, store):
    rows = [(json.dumps(document("b", size)), NOW, place) for place, size in enumerate([1, 2, 2])]
    landed = spark.createDataFrame(rows, "value string, collected_at timestamp_ntz, arrival int")
    refresh.bulk_refresh(spark, store, landed)
    hist = store.tables(spark).hist.collect()
    assert len({r.id for r in hist}) == 3 and sorted(r.size_bytes for r in hist) == [1, 2, 2]


def _status(name, text):
    return {"bucket": name, "ok": True, "stdout": text, "stderr": ""}


def test_feeds_in_one_stream(spark, store, tmp_path):
    """Status before, with and after its document, list files cut and whole, and a restart."""
    folders = {k: str(tmp_path / k) for k in ("lines", "arrays", "sync")}
    checkpoint = str(tmp_path / "checkpoint")
    for folder in folders.values():
        os.makedirs(folder)

    def land(kind, name, text, at):
        path = tmp_path / kind / name
        path.write_text(text)
        os.utime(path, (at, at))

    def drain():
        refresh_feeds(feeds(spark, **folders), store, checkpoint, once=True).awaitTermination()
        rows = store.tables(spark).cur.collect()
        return {r.bucket_name: (r.size_bytes, r.sync_status, r.sync_behind_shards) for r in rows}

    land("lines", "1", json.dumps(document("a", 1)) + "\n\n{broken\n", 1_800_000_000)
    text = json.dumps([document("b", 2), document("c", 3)])
    land("arrays", "1", text[:-9], 1_800_000_000)
    land("sync", "1", "\n".join(json.dumps(_status(n, f"{s} shards behind")) for n, s in (("b", 5_000_000_000), ("z", 7))), 1_800_000_000)
    assert drain() == {"a": (1, None, None), "b": (2, "behind", 5_000_000_000)}
    # the status of a, without a document; the document of z, whose status came before
    land("sync", "2", json.dumps(_status("a", "caught up")) + '\n{"stdout": "1 shard behind"}', 1_800_000_100)
    land("arrays", "2", json.dumps([document("z", 9)]), 1_800_000_100)
    assert drain() == {"a": (1, "synced", 0), "b": (2, "behind", 5_000_000_000), "z": (9, "behind", 7)}
    # an older status of b changes nothing, a new document keeps it
    land("sync", "3", json.dumps(_status("b", "1 shard behind")), 1_799_990_000)
    land("lines", "2", json.dumps(document("b", 20)), 1_800_000_200)
    assert drain() == {"a": (1, "synced", 0), "b": (20, "behind", 5_000_000_000), "z": (9, "behind", 7)}
    rows = refresh.run_metrics(spark, store).orderBy("version").collect()
    assert [(r.landed, r.collected, r.errors, r.readings) for r in rows] == [(4, 2, 2, 2), (1, 1, 0, 1), (1, 1, 0, 1)]
    assert [r.batch for r in rows] == [0, 1, 2] and len({r.stream for r in rows}) == 1
    lagging = Lens(store.tables(spark), NOW).lagging_by_shards().collect()
    assert [r.bucket_name for r in lagging] == ["b", "z"]


def test_duty_after_every_batch(spark, store, tmp_path):
    root, landing = str(tmp_path / "duty"), tmp_path / "landing"
    assert duty.read_worklist(spark, root).count() == 0 and duty.read_plan(spark, root).count() == 0
    names = [f"b{i}" for i in range(4)]

    def drain(at):
        inv = lambda: inventory(spark, names)
        refresh_folder(
            spark, str(landing), store, str(tmp_path / "c"), once=True, as_of=at, duty_root=root, inventory=inv
        ).awaitTermination()
        return rows_of(duty.read_worklist(spark, root))

    at = datetime.fromtimestamp(1_800_000_000, timezone.utc).replace(tzinfo=None)
    _land(landing, "1.json", [document("b1")], 1_800_000_000)
    assert drain(at) == [("b0", "uncollected"), ("b2", "uncollected"), ("b3", "uncollected")]
    _land(landing, "2.json", [document("b3"), document("x")], 1_800_003_600)
    names.append("b9")
    got = drain(at + timedelta(hours=1))
    assert got == [("b0", "uncollected"), ("b2", "uncollected"), ("b9", "uncollected"), ("b1", "stale")]
    plan = duty.read_plan(spark, root).first()
    assert (plan.total_buckets, plan.in_db, plan.to_update, plan.orphans, plan.mode) == (5, 3, 4, 1, "per-bucket")
    assert rows_of(duty.read_worklist(spark, root, 2)) == got[:2]


def test_snapshot_beside_its_table_stays_small(spark, store, tmp_path):
    root = tmp_path / "serving"

    def publish(version):
        cur = store.tables(spark).cur
        serving.publish_serving(cur, str(root), version, NOW, table=store.current, table_version=version)
        return sum(f.stat().st_size for f in (root / "data" / f"version={version}").rglob("*.parquet"))

    refresh.bulk_refresh(spark, store, documents(spark, [f"b{i:05d}" for i in range(200)], NOW))
    first = publish(1)
    before = serving.read_section(spark, str(root), "all_buckets").collect()
    refresh.bulk_refresh(spark, store, documents(spark, [f"b{i:05d}" for i in range(4000)], NOW, size=9))
    # a reader of the old version still finds its rows
    assert [r.size_bytes for r in before] == [1024] * 200
    second = publish(2)
    rows = serving.read_section(spark, str(root), "all_buckets").collect()
    assert [r.bucket_name for r in rows] == [f"b{i:05d}" for i in range(4000)] and {r.size_bytes for r in rows} == {9}
    assert rows[0].collected_at == str(NOW) + ".000000" or rows[0].collected_at == str(NOW)
    assert second < 1.5 * first
    assert serving.read_section(spark, str(root), "all_buckets", 3).count() == 3
    assert serving.read_section(spark, str(root), "summary").first().total_buckets == 4000


def test_what_is_set_aside_stays(spark, store):
    assert refresh.run_quarantine(spark, store).count() == 0
    good = documents(spark, ["a"], NOW)
    bad = spark.createDataFrame([("{broken", NOW), ('{"owner": "o"}', NOW)], good.schema)
    refresh.bulk_refresh(spark, store, good)
    refresh.bulk_refresh(spark, store, good.unionByName(bad))
    rows = refresh.run_quarantine(spark, store).select("value", "reason", "version")
    assert sorted(rows_of(rows)) == [('{"owner": "o"}', "no entity name", 2), ("{broken", "unreadable", 2)]
