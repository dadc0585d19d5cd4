"""Embedding near-duplicates against brute force, recall, several shards, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest

from usagelens.llm import hnsw

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    """vec_id -> (n_links, component_id) by all pairs of a label."""
    ids = [r[0] for r in rows]
    parent = {v: v for v in ids}
    links = dict.fromkeys(ids, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    labels = {}
    for v, e, label in rows:
        good = label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)
        if good:
            labels.setdefault((label, len(e)), []).append((v, np.array(e, np.float32).astype(np.float64)))
    for members in labels.values():
        unit = np.array([e / np.sqrt((e * e).sum()) for _, e in members])
        for i, j in zip(*np.nonzero(np.triu(unit @ unit.T >= least, 1)), strict=True):
            a, b = members[i][0], members[j][0]
            links[a] += 1
            links[b] += 1
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {v: (links[v], root(v)) for v in ids}


def result(frame):
    return {r.vec_id: (r.n_links, r.component_id) for r in frame.collect()}


def test_documents_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding, r.label) for r in frame.collect()])
    got = hnsw.near_duplicates(frame)
    assert result(got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.collect())


def vectors(n, groups, rng, spread=0.15):
    centre = rng.normal(size=(groups, 32))
    v = centre[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, 32)) * rng.random((n, 1))
    return np.concatenate([v, rng.normal(size=(n // 2, 32))])


@pytest.mark.parametrize("shard", [400, 10_000])
def test_recall_with_several_shards(spark, shard):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors(1600, 60, rng).astype(np.float32))]
    rows += [(len(rows) + k, rows[7][1], 1) for k in range(300)]
    want = brute(rows)
    got = result(hnsw.near_duplicates(spark.createDataFrame(rows, ROWS), shard=shard))
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values())
    assert all(got[v][0] <= want[v][0] for v in want)
    assert sum(got[v][1] == want[v][1] for v in want) >= 0.97 * len(want)


def test_graph_search_beats_the_audit():
    rng = np.random.default_rng(2)
    shard = hnsw.Shard(vectors(4000, 300, rng))
    assert shard.recall >= hnsw.RECALL and shard.beam < len(shard.unit) // 4
    true = [set(np.flatnonzero(row >= 0.93)) for row in shard.unit @ shard.unit.T]
    got = [set(near) for near in shard.links(shard.unit)]
    assert all(g <= t for g, t in zip(got, true, strict=True))
    assert sum(map(len, got)) >= 0.97 * sum(map(len, true))


def test_odd_vectors(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, a, 0), (2, a, 0), (2, a, 0), (3, [2.0, 0.0], 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [0.0, -0.0], 0),
        (8, [1.0, None], 0), (9, [1.0, float("nan")], 0), (10, [float("inf"), 0.0], 0), (11, [], 0), (12, [1.0], 0),
        (13, b, 0), (None, b, 0), (None, [0.0, 3.0], 2), (14, [1.0, -0.0], 0),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", kept int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in hnsw.near_duplicates(frame).collect())
    alone = [(v, 0, v, True) for v in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    together = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (14, 4, 1, False)]
    assert got == sorted([*alone, *together, (13, 1, 13, True), (0, 1, 13, False), (0, 0, 0, False)])
    assert hnsw.near_duplicates(spark.createDataFrame([], ROWS)).count() == 0


def test_audit_counts_no_point_as_its_own_link():
    """Rare links: 4,000 free points and 40 pairs; an audit of queries from elsewhere, too."""
    rng = np.random.default_rng(6)
    free = rng.normal(size=(4000, 32))
    pairs = free[:40] + 0.02 * rng.normal(size=(40, 32))
    shard = hnsw.Shard(np.concatenate([free, pairs]))
    assert 0 < shard.true <= 200 and shard.hits >= hnsw.RECALL * shard.true
    before = shard.true
    shard.audit(hnsw.unit_rows(free[::4] + 0.02 * rng.normal(size=(1000, 32))))
    assert shard.true >= before + hnsw.AUDIT and shard.recall >= hnsw.RECALL


def test_links_count_both_ways():
    got = hnsw._both_ways([np.array([0, 2]), np.array([1]), np.array([2]), np.array([0], np.int64)])
    assert [x.tolist() for x in got] == [[0, 2, 3], [1], [0, 2], [0]]
