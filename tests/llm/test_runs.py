"""Periodic runs against brute force, planted tails, long and odd texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from usagelens.llm import queries, runs

DOCS = "doc_id long, text string"


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def slow_runs(words, least=24, times=3):
    """(start, length, period) by trying every period over the whole text."""
    found = {}
    for q in range(1, len(words) // times + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)]
        i = 0
        while i < len(same):
            if not same[i]:
                i += 1
                continue
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            # a multiple of a smaller period of the same stretch is no run of its own
            if length >= max(least, times * q) and not any(
                q % p == 0 for (s, n), p in found.items() if s == i and n == length
            ):
                found[i, length] = q
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_collapsed(words, found):
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def slow_row(doc_id, text):
    words = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    best = min(found, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id,
        len(found),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(slow_collapsed(words, found)),
    )


def check(spark, texts, **least):
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in runs.find_runs(docs, **least).collect()}
    for i, text in enumerate(texts):
        found = slow_runs(words_of(text), least.get("words", 24), least.get("times", 3))
        assert [tuple(r) for r in got[i].runs] == found, text[:200]
        assert got[i].text == slow_collapsed(words_of(text), found)


def samples():
    rng = random.Random(5)
    texts = []
    for alphabet in (1, 2, 3, 5):
        for n in (23, 24, 25, 60, 200):
            texts.append(" ".join(str(rng.randrange(alphabet)) for _ in range(n)))
    for _ in range(150):  # periods one after the other, with shared words and damage
        words = []
        for _ in range(rng.randint(1, 6)):
            root = [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
            words += root * rng.randint(1, 8) + root[: rng.randrange(len(root))]
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "x"
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    a, b = "a", "a b"
    for _ in range(9):  # Fibonacci words: runs of every scale
        a, b = b, f"{b} {a}"
    thue = [0]
    for _ in range(9):
        thue += [1 - x for x in thue]
    return [*texts, b, " ".join(map(str, thue)), " ".join(["a"] * 500)]


def test_against_brute_force(spark):
    check(spark, samples())


def test_other_limits(spark):
    check(spark, samples()[:60], words=6, times=2)
    check(spark, samples()[:60], words=10, times=4)


def test_each_row_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, sf_dir).collect()]
    short = {d: t for d, t in docs.items() if len(words_of(t)) <= 1500}
    assert len(got) == len(docs) and len(short) > 150 and any(r[1] for r in got)
    by = {r[0]: r for r in got}
    for d, text in short.items():
        assert by[d] == slow_row(d, text)


def test_parts_of_a_batch_give_the_same(spark, monkeypatch):
    texts = samples()
    words = runs._Words(pa.array(texts))
    whole = runs.runs_of(words, 24, 3)
    for k, text in enumerate(texts):
        alone = runs.runs_of(runs._Words(pa.array([text])), 24, 3)
        own = whole[whole[:, 0] == k]
        assert np.array_equal(own[:, 1:3] - words.first[k], alone[:, 1:3]) and np.array_equal(own[:, 3], alone[:, 3])


def test_very_long_text(spark):
    """300,000 words: one word throughout, a long period, and no period at all."""
    rng = random.Random(9)
    root = [str(rng.randrange(10**6)) for _ in range(70_000)]
    free = [str(rng.randrange(10**6)) for _ in range(300_000)]
    docs = [(1, "a " * 300_000), (2, " ".join((root * 5)[:300_000])), (3, " ".join(free))]
    got = {r.doc_id: r for r in runs.find_runs(spark.createDataFrame(docs, DOCS)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 1)] and got[1].text == "a"
    assert [tuple(r) for r in got[2].runs] == [(0, 300_000, 70_000)] and got[2].text == " ".join(root)
    assert got[3].runs == [] and got[3].text == docs[2][1]


def test_odd_rows(spark):
    rows = [(None, None, 1, "x"), (1, "", 2, "x"), (1, " \t\n", 3, "y"), (2, "é é " * 20, 80, None), (2, "é é " * 20, 80, None)]
    rows.append((3, "  " * 30 + "end", 63, "z"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, runs string")
    got = sorted((tuple(r) for r in runs.find_runs(docs).collect()), key=str)
    assert sorted(((d, [tuple(r) for r in f]) for d, _, f in got), key=str) == sorted(
        [(None, []), (1, []), (1, []), (2, [(0, 40, 1)]), (2, [(0, 40, 1)]), (3, [(0, 30, 1)])], key=str
    )
    kept = sorted((tuple(r) for r in runs.collapse(docs).collect()), key=str)
    assert kept == sorted([*rows[:3], (2, "é", 1, None), (2, "é", 1, None), (3, "  end", 5, "z")], key=str)
    nothing = spark.createDataFrame([], DOCS)
    assert runs.find_runs(nothing).count() == 0 and runs.digests(runs.find_runs(nothing)).count() == 0


@pytest.mark.parametrize("text", [None, "", "a", "a " * 23, "a b c " * 8])
def test_single_rows(spark, text):
    docs = spark.createDataFrame([(10, text)], DOCS)
    rows = runs.digests(runs.find_runs(runs.with_periodic_tails(docs))).collect()
    assert [tuple(r) for r in rows] == [slow_row(10, text)]
