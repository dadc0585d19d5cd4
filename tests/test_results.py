"""Summaries, growth, comparison, labels: hand-made cases and brute force."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from conftest import NOW, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagelens.functions import labels
from usagelens.operators import compare, export, growth, listing, normalize, replication, summary
from usagelens.plans import reports
from usagelens.schemas import CLASS_USAGE
from usagelens.sources import tables


def test_summary(make_cur):
    cur = make_cur(
        *[
            {
                "bucket_name": f"b{i}",
                "owner": f"user-{i % 2}",
                "num_objects": 100 * (i + 1),
                "size_bytes": 1024 * (i + 1),
                "collected_at": NOW,
            }
            for i in range(5)
        ]
    )
    row = summary.cluster_summary(cur).first()
    assert (row.total_buckets, row.total_owners, row.total_objects) == (5, 2, 1500)
    owners = rows_of(summary.summary_by_owner(cur))
    assert owners == [("user-0", 3, 900, 9216), ("user-1", 2, 600, 6144)]
    assert summary.summary_by_owner(cur, limit=1).count() == 1
    assert [r.bucket_name for r in listing.top_by_size(cur, 2).collect()] == ["b4", "b3"]


def test_empty_tables(make_cur, make_hist):
    cur, hist = make_cur(), make_hist()
    assert rows_of(summary.cluster_summary(cur)) == [(0, 0, 0, 0, None, None)]
    assert rows_of(summary.collection_freshness(cur, NOW)) == [(0, 0, 0.0, 0, 0.0, 0, 0.0, None, None)]
    assert rows_of(compare.compare_snapshots(cur, hist, NOW)) == [(0, 0, 0, 0, 0, 0, 0, 0, 24)]
    assert rows_of(summary.status_rollup(cur, NOW))[0][:4] == (0, 0, 0, 0)
    for empty in [
        growth.cluster_growth(hist, NOW),
        growth.fastest_growing_entities(hist, cur, NOW),
        growth.fastest_growing_owners(hist, cur, NOW),
        compare.entity_changes(hist, cur, NOW),
        compare.entity_comparison(cur, hist, NOW),
        replication.sync_comparison(cur, hist, NOW),
        summary.freshness_bands(cur, NOW),
    ]:
        assert empty.count() == 0


def test_null_owner_is_a_group_but_not_counted(make_cur):
    cur = make_cur({"bucket_name": "a", "collected_at": NOW}, {"bucket_name": "b", "collected_at": NOW})
    cur = cur.withColumn("owner", F.when(F.col("bucket_name") == "a", "x"))
    assert summary.cluster_summary(cur).first().total_owners == 1
    assert sorted(r.owner or "" for r in summary.summary_by_owner(cur).collect()) == ["", "x"]


def test_ties_are_ordered_by_name(make_cur):
    cur = make_cur(*[{"bucket_name": n, "size_bytes": 5, "collected_at": NOW} for n in "cab"])
    assert [r.bucket_name for r in listing.top_by_size(cur, 2).collect()] == ["a", "b"]
    assert [r.bucket_name for r in listing.listing(cur, NOW, "unknown", 2).collect()] == ["a", "b"]


def test_freshness_with_and_without_time(make_cur):
    ages = {"a": 60, "b": 400, "c": 1800, "d": 7200, "e": 200_000, "n": None}
    cur = make_cur(
        *[
            {"bucket_name": n, "collected_at": None if a is None else NOW - timedelta(seconds=a)}
            for n, a in ages.items()
        ]
    )
    row = summary.collection_freshness(cur, NOW).first()
    assert (row.total, row.fresh_5m, row.fresh_10m, row.fresh_1h) == (6, 1, 2, 3)
    assert row.fresh_1h_pct == 50.0
    assert dict(rows_of(summary.freshness_bands(cur, NOW))) == {
        "fresh_10m": 2, "fresh_1h": 1, "fresh_24h": 1, "stale": 2,
    }
    assert rows_of(summary.stale_ladder(cur, NOW)) == [
        (60, "1m", 5), (300, "5m", 5), (600, "10m", 4), (3600, "1h", 3),
    ]
    assert rows_of(summary.timestamp_health(cur))[0][:2] == (6, 1)
    report = reports.freshness_report(cur, NOW).first()
    assert (report.stale, report.stale_pct) == (3, 50.0)
    last = listing.listing(cur, NOW, "age", 10).collect()[-1]
    assert (last.bucket_name, last.age_seconds) == ("n", None)


def test_growth_and_changes(make_cur, make_hist):
    h = timedelta(hours=1)
    hist = make_hist(
        ("grow", NOW - 10 * h, 100, 1),
        ("grow", NOW - 2 * h, 300, 2),
        ("shrink", NOW - 10 * h, 500, 1),
        ("shrink", NOW - 2 * h, 100, 1),
        ("once", NOW - 2 * h, 9, 1),
        ("from zero", NOW - 9 * h, 0, 0),
        ("from zero", NOW - h, 50, 1),
        ("unlisted", NOW - 9 * h, 1, 0),
        ("unlisted", NOW - h, 99, 1),
        ("old", NOW - 400 * h, 1, 1),
    )
    cur = make_cur(
        *[
            {"bucket_name": n, "owner": "o", "size_bytes": s, "num_objects": 1, "collected_at": NOW}
            for n, s in [("grow", 300), ("shrink", 100), ("once", 9), ("from zero", 50), ("old", 1)]
        ]
    )
    # the spread has no sign
    assert rows_of(growth.fastest_growing_entities(hist, cur, NOW)) == [
        ("shrink", "o", 100, 500, 400),
        ("grow", "o", 100, 300, 200),
        ("from zero", "o", 0, 50, 50),
    ]
    # growth from nothing is 0 %, so it never qualifies
    assert rows_of(compare.entity_changes(hist, cur, NOW)) == [
        ("shrink", "o", 500, 100, -400, -80.0),
        ("grow", "o", 100, 300, 200, 200.0),
    ]
    assert rows_of(compare.entity_changes(hist, cur, NOW, min_change_pct=100))[0][0] == "grow"
    owners = growth.fastest_growing_owners(hist, cur, NOW)
    assert rows_of(owners) == [("o", 1059, 1059, 0)]


def test_comparison_without_past(make_cur, make_hist):
    start = NOW - timedelta(days=7)
    hist = make_hist(
        ("a", start + timedelta(hours=5), 70, 7),
        ("a", start + timedelta(hours=1), 50, 5),
        ("a", start + timedelta(hours=30), 1, 1),
        ("z", start, 0, 0),
    )
    cur = make_cur(
        *[
            {"bucket_name": n, "size_bytes": 100, "num_objects": 10, "collected_at": NOW}
            for n in ["a", "b", "z"]
        ]
    )
    got = {r.bucket_name: r for r in compare.entity_comparison(cur, hist, NOW).collect()}
    assert (got["a"].old_size, got["a"].size_delta, got["a"].obj_delta) == (50, 50, 5)
    assert got["a"].size_pct_change == 100.0 and got["a"].old_time == start + timedelta(hours=1)
    assert (got["b"].old_size, got["b"].size_delta, got["b"].size_pct_change) == (100, 0, 0.0)
    assert got["b"].old_time is None
    assert (got["z"].size_delta, got["z"].size_pct_change) == (100, 0.0)


def test_first_last_keeps_nulls(make_hist):
    h = timedelta(hours=1)
    hist = make_hist(("a", NOW, None, 1), ("a", NOW + h, 5, None), ("a", NOW + h, 6, 2))
    for frame in [hist, hist.drop("id")]:
        row = growth.first_last_per_entity(frame, ["size_bytes"]).first()
        assert row.first_size_bytes is None and row.snapshots == 3
    with_id = growth.first_last_per_entity(hist, ["size_bytes", "num_objects"]).first()
    assert (with_id.last_size_bytes, with_id.last_num_objects) == (6, 2)


def test_first_last_without_id_runs_as_hash_aggregate(make_hist):
    hist = make_hist(("a", NOW, 1, 1))
    plain = growth.first_last_per_entity(hist.drop("id"), ["size_bytes"])
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def _line(totals: list[int], ahead: int) -> tuple[float, float]:
    n = len(totals)
    xs = range(n)
    sx, sy = sum(xs), sum(totals)
    sxy = sum(x * y for x, y in zip(xs, totals, strict=True))
    sxx = sum(x * x for x in xs)
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return slope, max(0, totals[-1] + slope * ahead)


@pytest.mark.parametrize("scale", [1, 10**15])
def test_forecast_against_a_plain_loop(spark, make_hist, scale):
    rng = random.Random(7)
    rows, daily = [], {}
    for day in range(1, 29, 3):
        for entity in range(4):
            size = rng.randrange(1000) * scale
            rows.append((f"b{entity}", NOW - timedelta(days=day), size, 1))
            daily.setdefault(day, []).append(size)
    totals = [sum(daily[d]) for d in sorted(daily, reverse=True)]
    slope, ahead = _line(totals, 90)
    row = growth.capacity_forecast(make_hist(*rows), NOW).first()
    assert row.current_bytes == totals[-1] and row.data_points == len(totals) and row.error is None
    assert row.daily_growth_bytes == pytest.approx(slope, rel=1e-12)
    assert row.forecast_bytes == pytest.approx(ahead, rel=1e-12)
    assert row.monthly_growth_bytes == pytest.approx(slope * 30, rel=1e-12)
    each = growth.capacity_forecast(make_hist(*rows), NOW, by=["bucket_name"]).collect()
    for r in each:
        mine = [s for n, _, s, _ in reversed(rows) if n == r.bucket_name]
        assert r.daily_growth_bytes == pytest.approx(_line(mine, 90)[0], rel=1e-12)


def test_forecast_edges(make_hist):
    one = growth.capacity_forecast(make_hist(("a", NOW, 5, 1)), NOW).first()
    assert (one.current_bytes, one.daily_growth_bytes, one.data_points) == (None, None, 1)
    assert one.error == "Insufficient data for forecast"
    none = growth.capacity_forecast(make_hist(), NOW).first()
    assert (none.data_points, none.error) == (0, "Insufficient data for forecast")
    falling = make_hist(("a", NOW - timedelta(days=2), 100, 1), ("a", NOW - timedelta(days=1), 10, 1))
    assert growth.capacity_forecast(falling, NOW).first().forecast_bytes == 0.0


def test_end_of_day_counts_each_entity_once(make_hist):
    day = datetime(2024, 4, 30)
    hist = make_hist(
        ("a", day + timedelta(hours=1), 10, 1),
        ("a", day + timedelta(hours=2), 20, 2),
        ("b", day + timedelta(hours=3), 5, 1),
    )
    assert rows_of(growth.cluster_growth(hist, NOW)) == [(day, 35, 4)]
    assert rows_of(growth.cluster_growth(hist, NOW, basis=growth.END_OF_DAY)) == [(day, 25, 3)]


def test_compare_snapshots(make_cur, make_hist):
    end = NOW - timedelta(hours=24)
    hist = make_hist(
        ("a", end, 10, 1),
        ("a", end - timedelta(minutes=60), 20, 2),
        ("b", end - timedelta(minutes=30), 5, 1),
        ("b", end - timedelta(minutes=61), 500, 1),
        ("b", end + timedelta(seconds=1), 500, 1),
    )
    cur = make_cur({"bucket_name": "a", "size_bytes": 50, "num_objects": 3, "collected_at": NOW})
    assert rows_of(compare.compare_snapshots(cur, hist, NOW)) == [(50, 3, 1, 35, 4, 2, 15, -1, 24)]


def test_sync_tables(make_cur, make_hist):
    cur = make_cur(
        {"bucket_name": "a", "sync_status": "behind", "sync_behind_shards": 3, "collected_at": NOW},
        {"bucket_name": "b", "sync_status": "synced", "collected_at": NOW},
        {"bucket_name": "c", "sync_status": "", "sync_behind_shards": 9, "collected_at": NOW},
        {"bucket_name": "d", "sync_status": "behind", "sync_behind_entries": 7, "collected_at": NOW},
    )
    hist = make_hist(("a", NOW, 1, 1, 2), ("a", NOW, 1, 1, 5), ("a", NOW - timedelta(days=2), 1, 1, 99))
    assert rows_of(replication.sync_status_summary(cur)) == [("behind", 2, 3), ("synced", 1, 0)]
    assert [r.bucket_name for r in replication.lagging_by_shards(cur).collect()] == ["c", "a"]
    assert [r.bucket_name for r in replication.lagging_by_entries(cur).collect()] == ["d", "a", "c"]
    got = replication.sync_comparison(cur, hist, NOW).collect()
    assert [(r.bucket_name, r.avg_shards_24h, r.max_shards_24h) for r in got] == [
        ("a", 3.5, 5), ("b", 0.0, 0), ("d", 0.0, 0),
    ]
    # the view filters before its limit: "b" does not lag and takes no place
    assert [r.bucket_name for r in reports.sync_report(cur, hist, NOW, 2).collect()] == ["a", "d"]


def _bytes_text(b: float | None) -> str:
    if not b:
        return "0 B"
    x = b
    for unit in labels.UNITS:
        if abs(x) < 1024 or unit == "PB":
            return f"{x:.1f} {unit}"
        x = x / 1024


def _age_text(s: float | None) -> str:
    if s is None:
        return "N/A"
    for limit, unit, mark in [(60, 1, "s"), (3600, 60, "m"), (86400, 3600, "h")]:
        if s < limit:
            return f"{int(s / unit)}{mark}"
    return f"{int(s / 86400)}d"


_SIZES = st.one_of(
    st.none(),
    st.integers(-(2**53), 2**53),
    # exact halves in the second decimal, where rounding modes differ
    st.builds(lambda n, k: n * 2**k // 20 * 5, st.integers(0, 2**20), st.integers(0, 32)),
)


@settings(max_examples=5, deadline=None)
@given(sizes=st.lists(_SIZES, min_size=200, max_size=400))
def test_bytes_labels(spark, sizes):
    extra = [0, 1, 1023, 1024, 1280, 1792, 2**20 - 1, 2**50, 2**62, -1536, 1024**6]
    df = spark.createDataFrame([(s,) for s in [*sizes, *extra]], "s bigint")
    for size, text in rows_of(df.select("s", labels.human_bytes(F.col("s")))):
        assert text == _bytes_text(size), size


def test_fractional_bytes_labels(spark):
    rng = random.Random(3)
    sizes = [None, 0.0, 861.485, -861.485, 1023.96, -1861.485, 1e6, 5.5e12, 3e18]
    sizes += [rng.uniform(-1, 1) * 10 ** rng.randrange(1, 18) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in sizes], "s double")
    for size, text in rows_of(df.select("s", labels.human_rate(F.col("s")))):
        assert text == _bytes_text(size), size


def test_other_labels(spark):
    ages = [None, 0.0, 59.9, 60.0, 3599.0, 3600.0, 86399.0, 86400.0, 200000.5]
    df = spark.createDataFrame([(a,) for a in ages], "a double")
    got = rows_of(df.select("a", labels.human_age(F.col("a")), labels.severity(F.col("a"))))
    for age, text, colour in got:
        assert text == _age_text(age)
        level = age or 0
        assert colour == ("red" if level > 3600 else "yellow" if level > 600 else "green")
    df = spark.createDataFrame([(12.25, 5), (-3.0, -2048), (0.0, 0), (1289.4936, 1)], "p double, d bigint")
    got = rows_of(df.select(labels.pct_label(F.col("p"), F.col("d")), labels.delta_label(F.col("d"))))
    assert got == [("+12.2%", "+5.0 B"), ("-3.0%", "-2.0 KB"), ("0%", "0 B"), ("+1289.5%", "+1.0 B")]
    df = spark.createDataFrame([("behind", 2), ("", 0), (None, 3), ("synced", None)], "s string, n int")
    got = rows_of(df.select(labels.sync_label(F.col("s"), F.col("n"))))
    assert [r[0] for r in got] == ["behind (2)", "-", "- (3)", "synced"]


def test_totals_past_bigint(make_hist, make_cur):
    """Four snapshots of 2^62 bytes add up to 2^64."""
    hist = make_hist(*[(f"b{i}", NOW - timedelta(hours=1), 2**62, 1) for i in range(4)])
    cur = make_cur(*[{"bucket_name": f"b{i}", "owner": "o"} for i in range(4)])
    assert growth.cluster_growth(hist, NOW).first().total_size == 2**64
    assert growth.fastest_growing_owners(hist, cur, NOW).first().end_size == 2**64
    two = hist.union(make_hist(*[(f"b{i}", NOW - timedelta(days=1), 2**62, 1) for i in range(4)]))
    assert growth.capacity_forecast(two, NOW).first().current_bytes == 2**64
    assert reports.forecast_report(two, NOW).first().current == "16384.0 PB"


def test_free_sql_leaves_the_session_alone(spark, make_cur, make_hist):
    spark.range(3).createOrReplaceTempView("bucket_stats")
    try:
        cur = make_cur({"bucket_name": "a"}, {"bucket_name": "b"})
        usage = spark.createDataFrame([], CLASS_USAGE)
        found = tables.custom_sql(spark, tables.Tables(cur, make_hist(("a", NOW, 1, 1)), usage), "SELECT bucket_name FROM bucket_stats")
        assert sorted(r.bucket_name for r in found.collect()) == ["a", "b"]
        assert spark.table("bucket_stats").columns == ["id"]
        assert not spark.catalog.tableExists("bucket_stats_history")
    finally:
        spark.catalog.dropTempView("bucket_stats")


def test_documents_in_files(spark, make_cur, tmp_path):
    cur = make_cur(*[{"bucket_name": f"b{i}", "owner": "o"} for i in range(5)])
    export.write_documents(export.export_all(cur), str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(json.loads(x)["bucket"] for x in lines) == [f"b{i}" for i in range(5)]
    assert json.loads(export.export_text(cur, "b3").first().document)["owner"] == "o"


def test_unknown_status_is_empty_for_a_reader(make_cur):
    row = normalize.with_defaults(make_cur({"bucket_name": "a"}).withColumn("sync_status", F.lit(None).cast("string"))).first()
    assert (row.sync_status, row.sync_behind_shards, row.sync_behind_entries, row.sync_source_zone) == ("", 0, 0, "")
