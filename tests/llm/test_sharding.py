"""Sharding: the law, slots, cut edges against a hash, odd rows."""

from __future__ import annotations

import zlib
from collections import Counter

from usagelens.llm import sharding


def check(rows, texts, shards=16):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and set(counts) <= set(range(shards))
    assert max(counts.values(), default=0) - min((counts[s] for s in range(shards)), default=0) <= 1
    for shard in counts:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(counts[shard]))
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    assert {(r.law, r.grown_shard) for r in rows} <= {("rows", None)}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed = sharding.shard_documents(docs)
    check(placed.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_groups_stay_together(spark):
    """Of 3,000 documents a third are copies of one text, a third in groups of four."""
    texts = ["hot"] * 1000 + [f"group {i // 4}" for i in range(1000)] + [f"single {i}" for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = sharding.shard_documents(docs)
    rows = placed.collect()
    check(rows, list(enumerate(texts)))
    edges = sharding.cut_edges(placed.where("size > 4")).first()
    assert edges["pairs"] == 250 * 6 and edges["cut"] <= 0.2 * edges["pairs"]  # by hash: 0.94
    hot = Counter(r.shard for r in rows if r.size == 4)
    assert len([s for s, n in hot.items() if n > 20]) <= 8


def test_rounds_lower_the_cut(spark):
    rows = spark.createDataFrame([(i, f"t{i // 5}") for i in range(2000)], "doc_id long, grp string")

    def cut(rounds):
        return sharding.cut_edges(sharding.propagate(rows, ["doc_id"], rounds=rounds), "grp").first()["cut"]

    assert cut(3) < 0.2 * cut(0)


def test_odd_rows(spark):
    texts = [(None, None), (1, ""), (1, None), (2, "é"), (2, "é"), (3, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, 5) for d, t in texts], "doc_id long, text string, shard int")
    check(sharding.shard_documents(docs).collect(), texts)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = sharding.shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_id_throughout(spark):
    """Rows that are equal in everything are still dealt evenly, and in salted parts."""
    texts = [(7, "copy")] * 4000 + [(7, f"t{i // 2}") for i in range(1000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    check(rows, texts)
    hot = Counter(r.shard for r in rows if r.text_crc32 == zlib.crc32(b"copy"))
    assert len([s for s, n in hot.items() if n > 30]) <= 14


def test_several_large_groups(spark):
    texts = ["a"] * 1500 + ["b"] * 900 + ["c"] * 300 + [f"s{i}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.shard_documents(docs).collect()
    check(rows, list(enumerate(texts)))
    by_id = {r.doc_id: r.shard for r in rows}
    for text, most in (("a", 11), ("b", 8), ("c", 4)):
        counts = Counter(by_id[i] for i, t in enumerate(texts) if t == text)
        assert len([n for n in counts.values() if n > 20]) <= most
