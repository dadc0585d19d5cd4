"""Every registered query against its SQL, and the shape of every plan."""

from __future__ import annotations

import re

import pytest
from check import differences, oracle

import __spark_entry__ as entry
from usagelens.catalog.oracle import all_sql
from usagelens.catalog.queries import all_queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries())
    assert set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_equals_sql(spark, con, key):
    frame = QUERIES[key](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    for forbidden in ["CartesianProduct", "NestedLoopJoin", "Python", "Pandas"]:
        assert forbidden not in plan
    # a window over everything is allowed only over rows whose number is bounded
    if "SinglePartition" in plan and "Window" in plan:
        assert key.startswith(("capacity_forecast", "forecast_report", "serving_"))
    problems = differences(frame, con, SQL[key])
    # small data: a few results are rightly empty
    assert [p for p in problems if p != "no rows"] == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_queries_find_rows_at_the_checked_scale(spark):
    con = oracle("/root/testdata/sf0.01")
    for key, sql in SQL.items():
        assert con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] > 0, key


def scan_lines(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_time_filter_and_columns_reach_the_scan(spark):
    plan = scan_lines(QUERIES["cluster_growth"](spark, SF))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,value:double>", plan)


def test_lookup_reaches_the_scan(spark, tmp_path):
    from usagelens.operators.listing import entity_history
    from usagelens.catalog.proxies import AS_OF, Proxies
    from usagelens.sinks.history import append_history, read_history

    path = str(tmp_path / "history")
    append_history(Proxies(spark, SF).hist().drop("storage_class"), path, 1)
    plan = scan_lines(entity_history(read_history(spark, path), "bucket-3", AS_OF, days=2))
    assert "EqualTo(bucket_name,bucket-3)" in plan
    assert re.search(r"PartitionFilters: \[.*collected_date.*>= 2024-01-29", plan)
    assert "num_objects" in plan and "sync_behind" not in plan


def test_top_k_does_not_sort_everything(spark):
    for key in ["top_by_size", "listing_by_age", "lagging_by_shards", "entity_comparison"]:
        plan = scan_lines(QUERIES[key](spark, SF))
        assert "TakeOrderedAndProject" in plan
        assert "rangepartitioning" not in plan


def test_rows_are_reduced_before_the_shuffle(spark):
    """The ordered first/last has a partial step, so a hot entity is not moved whole."""
    plan = scan_lines(QUERIES["first_last_per_entity"](spark, SF))
    assert plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")


def test_documents_are_parsed_once(spark):
    plan = scan_lines(QUERIES["ingest_snapshot"](spark, SF))
    # once for all documents; the second reading is below a condition only failures meet
    assert len(re.findall(r"inline\(array\(from_json\(StructField\(bucket,", plan)) == 1
    everywhere = re.findall(r".{50}from_json\(StructField\(bucket,", plan)
    assert all("inline(" in p or re.search(r"isnotnull\(_bad#\d+\) THEN ", p) for p in everywhere)
