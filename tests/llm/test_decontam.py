"""Decontamination against brute force, and what is cut out."""

from __future__ import annotations

import hashlib
import random
import re

from usagelens.llm import decontam

DOCS = "doc_id long, text string, n_chars long"
ITEMS = "item_id long, text string"


def slow_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def slow_scan(text, items):
    doc, hit, found = slow_words(text), set(), set()
    for item, body in items:
        seq = slow_words(body)
        n = min(10, len(seq))
        for w in range(len(seq) - n + 1) if n else ():
            for p in range(len(doc) - n + 1):
                if doc[p : p + n] == seq[w : w + n]:
                    hit |= set(range(p, p + n))
                    found.add("null" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(doc), len(hit), len(found), digest, bool(hit)


def check(spark, docs, items, **more):
    rows = decontam.contamination(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), **more
    ).collect()
    got = sorted((r.doc_id, *r[1:]) for r in rows)
    assert got == sorted((d, *slow_scan(t, items)) for d, t in docs)


def test_random_against_brute_force(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice("ab") for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 4, 9, 10, 11, 25]) if i % 3 else rng.randint(10, 30))) for i in range(12)]
    items = [(i, t) for i, t in items if len(t) != 1] + [(None, "A, b! Ä é"), (99, None), (98, "")]
    docs = [(i, text(rng.randint(0, 120))) for i in range(150)] + [(-1, None), (-2, ""), (-3, "x a b ä b Ä É é a b Ä é")]
    check(spark, docs, items)


def test_one_word_item_and_repeats(spark):
    check(spark, [(1, "b a b"), (1, "b a b"), (2, "c")], [(5, "A"), (5, "A"), (6, "b")])


def test_blocks_give_the_same(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = list(decontam.automata(items))
    small = list(decontam.automata(items, block_bytes=1000))
    assert len(whole) == 1 and len(small) > 5
    for r in rows.collect():
        seq = decontam.words(r.text)
        spans, found = whole[0].scan(seq)
        parts = [a.scan(seq) for a in small]
        assert decontam._merged([s for p, _ in parts for s in p]) == decontam._merged(spans)
        assert set().union(*(f for _, f in parts)) == found


def test_many_blocks_and_long_items(spark, monkeypatch):
    """Items far longer than a block, and many blocks, one in a worker's memory at a time."""
    rng = random.Random(7)
    text = lambda n, of: " ".join(f"{of}{rng.randrange(6)}" for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 12, 40]), "a")) for i in range(40)] + [(None, text(1500, "b")), (77, text(900, "a"))]
    parts = [t.split() for _, t in items]
    docs = []
    for i in range(60):
        own = rng.choice(parts)
        at = rng.randrange(len(own))
        docs.append((i, " ".join([text(rng.randrange(9), "a"), *own[at : at + rng.randint(1, 30)], text(5, "b")])))
    frame = spark.createDataFrame(items, ITEMS)
    blocks = decontam.build(frame, block_bytes=300)
    assert len(blocks.numbers) > 20
    monkeypatch.setattr(decontam, "build", lambda *_: blocks)
    check(spark, docs, items)


def test_very_long_text(spark):
    item = [f"w{i}" for i in range(200)]
    text = " ".join(["x y z"] * 100_000 + item[50:80] + ["end"] * 100_000)
    docs = spark.createDataFrame([(1, text, 0)], DOCS)
    items = spark.createDataFrame([(5, " ".join(item))], ITEMS)
    row = decontam.contamination(docs, items).first()
    assert (row.n_words, row.n_hit, row.n_items) == (400_030, 30, 1)
    cut = decontam.decontaminate(docs, items).first().text
    assert cut.split() == ["x", "y", "z"] * 100_000 + ["end"] * 100_000


def test_cutting(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame(
        [
            (1, "clean é text " * 9, 1),
            (2, "Ä lead " * 30 + item.upper() + ", tail.", 5),
            (3, item + " x", 9),
            (4, None, None),
            (5, "", 0),
            (None, "no id", 5),
        ],
        DOCS,
    )
    got = {r.doc_id: r for r in decontam.decontaminate(docs, spark.createDataFrame([(1, item)], ITEMS)).collect()}
    assert set(got) == {1, 2, 4, 5, None}
    assert got[1].text == "clean é text " * 9 and got[1].n_chars == 1
    assert got[2].text == "Ä lead " * 30 + ", tail." and got[2].n_chars == len(got[2].text)
    longer = decontam.decontaminate(docs, spark.createDataFrame([(1, item)], ITEMS), max_span=20, max_coverage=1.0)
    assert sorted(map(tuple, longer.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontam.contamination(docs, items).count() == 0
    assert decontam.decontaminate(docs, items).count() == 0
    check(spark, [(1, "a b")], [(1, None)])
