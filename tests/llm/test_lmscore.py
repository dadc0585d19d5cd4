"""Cross-entropy difference against a plain recount, and what it tells apart."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from usagelens.llm import lmscore

DOCS = "doc_id long, text string"


def slow(rows, targets):
    """The scores of (doc_id, text) rows by dictionaries over the words themselves."""
    found = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        found[doc] = list(zip([None, *w], w, strict=False))
    size = len({w for pairs in found.values() for _, w in pairs})
    tables = []
    for keep in (targets, found):
        pair = Counter(p for doc in found if doc in keep for p in found[doc])
        context = Counter(v for doc in found if doc in keep for v, _ in found[doc])
        tables.append((context, pair))

    def bits(p, table):
        context, pair = table
        return -math.log2((pair[p] + lmscore.SMOOTH / size) / (context[p[0]] + lmscore.SMOOTH))

    out = {}
    for doc, pairs in found.items():
        means = [sum(bits(p, t) for p in pairs) / max(1, len(pairs)) for t in tables]
        out[doc] = (len(pairs), *means, means[0] - means[1])
    return out


@pytest.mark.parametrize("span", [lmscore.RANGE, 5_000])
def test_against_recount(spark, monkeypatch, span):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = lmscore.good_documents(labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    size = len({w for _, t in rows for w in (t or "").encode().lower().split()})
    about, total = lmscore.vocabulary(docs)
    assert abs(about - size) < 0.05 * size and total == sum(len((t or "").split()) for _, t in rows)
    monkeypatch.setattr(lmscore, "vocabulary", lambda _: (size, total))
    want = slow(rows, {r.doc_id for r in good.collect()})
    got = {r.doc_id: tuple(r)[1:] for r in lmscore.score(docs, good, span).collect()}
    assert set(got) == set(want)
    for doc, row in want.items():
        assert got[doc][0] == row[0] and got[doc][1:] == pytest.approx(row[1:], rel=1e-5, abs=1e-5)


def test_keys():
    context, pair = lmscore.coded("A b a B")
    assert context[0] == 0 and context[1] == context[3] != context[2]
    assert pair[1] == pair[3] != pair[2] and max(pair) < 1 << 48
    assert np.array_equal(lmscore.coded("a  b\tA\nb")[1], pair)


def test_long_texts_by_slices(monkeypatch):
    text = "one  two\nthree " * 40 + "x" * 90 + " end"
    monkeypatch.setattr(lmscore, "_SLICE", 16)
    assert [w for some in lmscore.words(text) for w in some] == text.encode().split()


def test_packed():
    for numbers in ([], [5], [0, 2**48 - 1, 7]):
        some = np.array(numbers, np.uint64)
        assert np.array_equal(lmscore.unpacked(lmscore.packed(some)), some)


def test_target_like_documents_score_lower(spark):
    rows = [(i, "the cat sat on the mat " * 5) for i in range(20)]
    rows += [(100 + i, "buy now cheap pills best price " * 5) for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    got = {r.doc_id: r.difference for r in lmscore.score(docs, targets).collect()}
    assert max(got[i] for i in range(20)) < min(got[100 + i] for i in range(20))


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "x " * 200_000)]
    docs = spark.createDataFrame([(*r, True) for r in rows], DOCS + ", target boolean")
    labels = spark.createDataFrame(
        [(None, 1, 0), (1, 1, None), (1, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int"
    )
    assert [r.doc_id for r in lmscore.good_documents(labels).collect()] == [3]
    got = lmscore.score(docs, lmscore.good_documents(labels)).collect()
    assert len(got) == 5
    assert sorted((r.n_words, r.difference == 0) for r in got) == [(0, True)] * 3 + [(2, False), (200_000, False)]
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.score(docs, none).count() == 5
    assert lmscore.score(spark.createDataFrame([], DOCS), none).count() == 0


def test_vocabulary_is_exact(spark):
    texts = [" ".join(f"w{i * k % 7001}" for k in range(400)) for i in range(300)] * 2 + [None, "", "W1 w1"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS).repartition(7)
    found = [w for t in texts for w in (t or "").lower().split()]
    assert lmscore.vocabulary(docs) == (len(set(found)), len(found))
