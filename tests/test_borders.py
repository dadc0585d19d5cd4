"""Elements of list files read in parts: nested values, strings full of brackets, cut files."""

from __future__ import annotations

import json
import os
import random

import pytest
from conftest import rows_of

from usagelens.operators import normalize
from usagelens.sources import borders, inventory, snapshots


@pytest.fixture
def small_blocks(spark):
    """Files are read in blocks of 20 kB."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 4)
    if kind == 0:
        return rng.choice([rng.randrange(1000), True, None, -1.5e-3])
    if kind <= 3:
        return "".join(rng.choice('a,{}[]"\\ \n:é\U0001f642') for _ in range(rng.randrange(14)))
    if kind <= 5:
        return {f'k"{i},{{': value(rng, depth + 1) for i in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def by_file(rows):
    found = {}
    for r in rows:
        found.setdefault(os.path.basename(r.file), []).append((r.pos, r.value, r.broken))
    return {f: sorted(rows) for f, rows in found.items()}


def test_random_lists(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    want = {}
    for f, n in enumerate([0, 1, 2, 30, 30, 3000, 3000]):
        values = [value(rng) for _ in range(n)]
        text = json.dumps(values, indent=rng.choice([None, 4]), ensure_ascii=rng.random() < 0.5)
        (tmp_path / f"{f}.json").write_text(rng.choice(["", "\n "]) + text + rng.choice(["", " \n"]))
        want[f"{f}.json"] = values
    raw = spark.read.option("lineSep", ",").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 8
    got = by_file(borders.list_items(spark, str(tmp_path)).collect())
    for f, values in want.items():
        rows = got.get(f, [])
        assert [(p, json.loads(v), b) for p, v, b in rows] == [(i, v, False) for i, v in enumerate(values)]


def test_cut_lists_keep_whole_elements(spark, tmp_path):
    rng = random.Random(2)
    values = [value(rng) for _ in range(120)]
    text = json.dumps(values)
    ends, at = [], 1
    for v in values:
        ends.append(at + len(json.dumps(v)))
        at = ends[-1] + 2
    cuts = sorted({*rng.sample(range(1, len(text)), 25), ends[3], ends[4] + 1, ends[5] + 2, ends[5] - 1})
    for c in cuts:
        (tmp_path / f"{c}").write_text(text[:c])
    got = by_file(borders.list_items(spark, str(tmp_path)).collect())
    for c in cuts:
        rows = got[str(c)]
        whole = [json.loads(v) for _, v, broken in rows if not broken]
        n = sum(e <= c for e in ends)
        # a number right before the cut may go on
        least = n - (n > 0 and not isinstance(values[n - 1], (dict, list, str)))
        assert whole == values[: len(whole)] and least <= len(whole) <= n
        assert [broken for _, _, broken in rows] == [False] * len(whole) + [True]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("", []),
        (" \n", []),
        ("[]", []),
        (" [ \n] ", []),
        ("[", [("", True, True)]),
        ('{"a": [1, 2]}', [('{"a": [1, 2]}', False, False)]),
        ("hello, world", [("hello, world", False, False)]),
        ("[1] trailing, x", [("1] trailing, x", True, True)]),
        ("[1,,2]", [("1", False, True), ("", False, True), ("2", False, True)]),
        ('["a,b", "c\\"]"]', [('"a,b"', False, True), ('"c\\"]"', False, True)]),
    ],
)
def test_single_files(spark, tmp_path, text, want):
    (tmp_path / "a").write_text(text)
    rows = borders.list_items(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.value, r.broken, r.listed) for r in rows] == want


def test_documents_of_cut_files(spark, tmp_path):
    """All whole documents, and one error row a file, also if the rest reads like a document."""
    docs = [{"bucket": f"b{i}", "usage": {"x": {"size": i}, "y": {"size": 1}}} for i in range(100)]
    text = json.dumps(docs)
    (tmp_path / "cut").write_text(text[: text.index('"b90"')])
    (tmp_path / "behind").write_text(json.dumps(docs[:3]) + ' {"bucket": "c"}')
    (tmp_path / "whole").write_text(text)
    parsed = snapshots.parse_documents(snapshots.read_arrays(spark, str(tmp_path)))
    records = normalize.normalize(snapshots.good_documents(parsed)).collect()
    assert len(records) == 90 + 2 + 100 and sum(r.size_bytes for r in records if r.bucket_name == "b7") == 16
    bad = snapshots.quarantine(parsed).collect()
    assert [r.reason for r in bad] == ["unreadable"] * 2


def test_unreadable_list_in_a_row(spark):
    rows = [('[{"bucket": "a"}, {"bucket": "b"}]',), ('[{"bucket": "c"}, {"buck',), ('{"bucket": "d"}',)]
    split = snapshots.split_arrays(spark.createDataFrame(rows, "value string").selectExpr("value", "timestamp_ntz'2024-01-01' collected_at"))
    parsed = snapshots.parse_documents(split)
    assert sorted(r.bucket for r in snapshots.good_documents(parsed).collect()) == ["a", "b", "d"]
    assert rows_of(snapshots.quarantine(parsed).select("value", "reason")) == [(rows[1][0], "unreadable")]


def test_many_names_in_one_line(spark, tmp_path):
    names = [f"bucket-{i}" for i in range(200_000)]
    (tmp_path / "list.json").write_text(json.dumps(names))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        got = inventory.read_inventory(spark, str(tmp_path)).orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.pos, r.bucket_name) for r in got] == list(enumerate(names))


def test_inventory_problems(spark, tmp_path):
    (tmp_path / "a").write_text('{"error": "denied"}')
    (tmp_path / "b").write_text('["x", "y')
    (tmp_path / "c").write_text('["z"]')
    items = borders.list_items(spark, str(tmp_path))
    assert sorted(r.bucket_name for r in inventory.listed_names(items).collect()) == ["x", "z"]
    assert sorted(rows_of(inventory.inventory_problems(items).select("value", "reason"))) == [
        ('"y', "cut list"),
        ('{"error": "denied"}', "not a list"),
    ]
