"""Centroid clustering against plain Python; bounds against exact distances; odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from usagelens.llm import ptolemy, queries

EMB = "vec_id long, embedding array<double>, label int"


def slow_clusters(rows, k=40, rounds=5):
    """The contract in plain whole numbers: rows as they are returned, without digests."""
    vectors = []
    for v, x in rows:
        if x is None or len(x) != 64 or any(c is None or not math.isfinite(c) for c in x):
            continue
        vectors.append((v, [math.floor(256 * c) for c in x]))
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        found = {}
        for _, x in vectors:
            found.setdefault(nearest(x)[1], []).append(x)
        for i, own in found.items():
            centroids[i] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(v, *nearest(x)[::-1]) for v, x in vectors]
    total = sum(d for _, _, d in out)
    per = {}
    for _, c, d in out:
        per[c] = per.get(c, 0) + d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, c, d, per[c], total, digest[c]) for v, c, d in out), key=str)


def result(spark, rows, **more):
    table = spark.createDataFrame([(v, x, 1) for v, x in rows], EMB)
    found = ptolemy.with_inertia(*ptolemy.cluster_vectors(table, **more))
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_query_against_plain_python(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_centroid_clustering(spark, sf_dir).collect()), key=str)
    assert got == slow_clusters(rows)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25]) * (j < 3) for j in range(64)]) for i in range(150)]  # many equal distances
    rows += [(i % 7, [1.5] * 64) for i in range(60)] + [(None, [2.0] * 64), (None, [2.0] * 64)]
    odd = [
        (900, None),
        (901, []),
        (902, [1.0] * 63),
        (903, [None] + [1.0] * 63),
        (904, [float("nan")] * 64),
        (905, [float("inf")] + [0.0] * 63),
    ]
    assert result(spark, rows + odd) == slow_clusters(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)] + [(1, [1.0] * 64)]
    assert result(spark, rows) == slow_clusters(rows)
    assert result(spark, []) == []


def test_large_numbers(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-5e5, 5e5) for _ in range(64)]) for i in range(60)]
    assert result(spark, rows) == slow_clusters(rows)
    with pytest.raises(Exception, match="beyond"):
        result(spark, [*rows, (61, [1e6] * 64)])


def test_bounds_never_exceed_distances_and_prune():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (40, 64))
    points = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 64))).astype(np.int64)
    pruner = ptolemy.Pruner(centres, ptolemy.choose_pivots(centres))
    near = ptolemy.distances(points, pruner.pivots)
    true = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (pruner.bounds(near) ** 2 <= true).all()
    cluster, square, computed = pruner.assign(points, near)
    assert (cluster == true.argmin(axis=1)).all() and (square == true.min(axis=1)).all()
    assert computed < 0.2 * true.size


def test_bounds_of_collinear_points_are_tight():
    """On a line the bound equals the distance: rounding must not put it above."""
    line = np.arange(-2000, 2000, 7)[:, None] * np.ones((1, 64), np.int64)
    pruner = ptolemy.Pruner(line[::50], ptolemy.choose_pivots(line[::50]))
    cluster, square, _ = pruner.assign(line, ptolemy.distances(line, pruner.pivots))
    true = ((line[:, None, :] - pruner.centroids[None]) ** 2).sum(axis=2)
    assert (cluster == true.argmin(axis=1)).all() and (square == true.min(axis=1)).all()
