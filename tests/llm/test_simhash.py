"""SimHash components against brute force, planted distances, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from usagelens.llm import simhash

DOCS = "doc_id long, text string"


def slow_fingerprint(text):
    words = [] if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words or "") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if bin(x ^ y).count("1") <= 3:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: root(d) for d in parent}


@pytest.mark.parametrize(
    "text", [None, "", " \t\n", "One", "a b", "A b\tc", "x  y\nz w \x0b v", "é É ß A B c d", "a b c " * 30000]
)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_sample_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = slow_components(rows)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {d: (f, want[d]) for d, f in rows}


def test_links_keep_what_all_pairs_connect():
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])))
            fps.add(centre)
    fps = sorted(fps)
    keys, owners = simhash.variants(np.array(fps, np.uint64))
    order = np.argsort(keys)
    a, b = simhash.links(keys[order], owners[order])
    known = np.array(fps, np.uint64)
    label = simhash._forest(len(fps), np.searchsorted(known, a), np.searchsorted(known, b))
    want = slow_components(list(enumerate(fps)))
    assert dict(enumerate(label.tolist())) == want


def test_large_bucket_search_equals_forest():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 16, 3000).astype(np.uint64) << np.uint64(3))
    i, j = np.triu_indices(len(fps), 1)
    near = simhash._close(fps[i], fps[j])
    assert np.array_equal(simhash._search(fps), simhash._forest(len(fps), i[near], j[near]))


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (7, None), (5, ""), (None, "q r s t u"), (None, "q r s t u")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", component_id string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 3), (3, 3), (3, 3), (5, 5), (7, 5)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q r s t u"), (3, "a b c d"), (5, "")]


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Each component keeps one row, whatever other components its smallest id occurs in."""
    one, two, three = ("alpha beta gamma delta", "epsilon zeta eta theta", "iota kappa lambda mu")
    cases = [
        ([(1, one), (1, two), (2, two.upper())], [(1, one), (1, two)]),
        ([(3, one), (5, one.upper()), (5, three)], [(3, one), (5, three)]),
        ([(1, one), (1, one), (1, two), (None, two), (None, three)], [(0, three), (1, one), (1, two)]),
    ]
    for rows, want in cases:
        kept = simhash.keep_one(spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", mark string"))
        assert kept.columns == ["doc_id", "text", "mark"]
        assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == want
