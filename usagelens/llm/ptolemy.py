"""Centroid clustering with Ptolemaic lower bounds.

Vectors become whole numbers, so every sum, centroid and squared distance is exact. A few
vectors far from each other are the pivots; each vector's distances to them are computed once
and kept beside it. For a pair of pivots p, s, Ptolemy's inequality bounds the distance of a vector
q and a centroid o from below by |d(q,p) d(o,s) - d(q,s) d(o,p)| / d(p,s). In a round a vector
checks the centroid of the smallest bound exactly; centroids whose bound over any of the fixed pairs
lies above that distance are out, all others are checked exactly. Bounds are lowered by more than their
rounding error, so none that could be nearest, or as near with a smaller number, is left out.

A round is one pass over the vectors: every task sums its own per cluster, Spark adds up one row
per task and cluster, and the driver gets one row per cluster. Centroids and pivots are the
only things sent to tasks; their number is a parameter.

Defined cases: vectors that are null, of another length, or hold null or non-finite components are
left out; ties go to the smaller number; repeated rows and ids count each; a null ``vec_id`` is
clustered but comes last as a start; starts of equal ids are ordered by their components;
fewer vectors than clusters make as many clusters as vectors; an empty table gives no rows;
other columns are not read. Whole numbers past 2^27 would not fit long distances: the
job stops with an error, no row is left out for it. Vectors hold no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import arrow_schema, discard, pieces, written

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
PIVOTS = 8
#: Whole numbers up to here keep squared distances of up to 64 components within 2^62.
LARGEST = 1 << 27
#: More than the relative rounding errors of a bound add up to (each is 2^-52 at most).
_SLACK = 2.0**-48
_ROWS = 4096
_WHOLE = "vec_id long, whole binary, near binary"


def kept(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, whole): the vectors that take part, as arrays of whole numbers."""
    x = "embedding"
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * float(scale)))
    return embeddings.where((F.size(x) == dimensions) & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole")
    )


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The first centroids: the vectors with the smallest hash of seed and id, in its order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.select(digest.alias("h"), "vec_id", "whole").orderBy(F.asc_nulls_last("h"), "vec_id", "whole")
    return _checked(np.array([r["whole"] for r in first.limit(clusters).collect()], np.int64))


def _checked(whole: np.ndarray) -> np.ndarray:
    if whole.size and max(abs(int(whole.max())), abs(int(whole.min()))) > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST} after scaling")
    return whole


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of paired rows."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def choose_pivots(points: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Points far from each other: each next one has the largest distance to those before."""
    chosen: list[int] = [0] if len(points) else []
    while chosen and len(chosen) < min(pivots, len(points)):
        near = np.min([_squares(points, points[c][None, :]) for c in chosen], axis=0)
        if not near.max():
            break
        chosen.append(int(near.argmax()))
    return points[chosen]


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Rounded distances of all points to a few others, from exact squares."""
    if not len(to):
        return np.zeros((len(points), 0))
    return np.sqrt(np.stack([_squares(points, t[None, :]) for t in to], axis=1).astype(np.float64))


@dataclass
class Pruner:
    """Centroids and fixed pivots of one round."""

    centroids: np.ndarray
    pivots: np.ndarray

    def __post_init__(self) -> None:
        self.far = distances(self.centroids, self.pivots)
        between = distances(self.pivots, self.pivots)
        n = len(self.pivots)
        self.pairs = [(p, s, between[p, s]) for p in range(n) for s in range(p) if between[p, s] > 0]

    def bounds(self, near: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances of vectors (by their pivot distances) to all centroids."""
        best = np.zeros((len(near), len(self.centroids)))
        for p, s, between in self.pairs:
            a = near[:, p, None] * self.far[None, :, s]
            b = near[:, s, None] * self.far[None, :, p]
            own = np.abs(a - b)
            own -= (a + b) * _SLACK
            own *= (1 - _SLACK) / between
            np.maximum(best, own, out=best)
        return best

    def assign(self, whole: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, exact squared distance) of each vector, and how many distances were computed."""
        low = self.bounds(near)
        cluster = low.argmin(axis=1)
        square = _squares(whole, self.centroids[cluster])
        # bounds are squared and lowered again before they are held against the exact square
        open_ = low * low * (1 - _SLACK) <= square[:, None] * (1 + _SLACK)
        open_[np.arange(len(whole)), cluster] = False
        row, other = np.nonzero(open_)
        more = np.concatenate(
            [np.zeros(0, np.int64)]
            + [
                _squares(whole[row[k : k + 65536]], self.centroids[other[k : k + 65536]])
                for k in range(0, len(row), 65536)
            ]
        )
        table = np.full(low.shape, np.iinfo(np.int64).max)
        table[row, other] = more
        table[np.arange(len(whole)), cluster] = square
        cluster = table.argmin(axis=1)  # the first of equal ones
        return cluster, table[np.arange(len(whole)), cluster], len(whole) + len(row)


def _with_pivots(vectors: DataFrame, pivots: np.ndarray, dimensions: int) -> DataFrame:
    """(vec_id, whole, near): numbers packed, with the distances to the pivots."""
    schema = arrow_schema(_WHOLE)

    def packed(values: np.ndarray) -> pa.Array:
        width = values.shape[1] * values.itemsize
        offsets = np.arange(len(values) + 1, dtype=np.int32) * width
        return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 65536):
                flat = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False)
                whole = _checked(flat.astype(np.int64).reshape(-1, dimensions))
                near = np.ascontiguousarray(distances(whole, pivots))
                columns = [part.column(0), packed(whole.astype(np.int32)), packed(near)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.mapInArrow(run, _WHOLE)


def _read(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for part in pieces(batch, _ROWS):
        whole, near = (b"".join(part.column(k).to_pylist()) for k in (1, 2))
        pivots = np.frombuffer(near, np.float64).reshape(part.num_rows, -1)
        yield part.column(0), np.frombuffer(whole, np.int32).reshape(-1, dimensions), pivots


def _sums(vectors: DataFrame, pruner: Pruner, dimensions: int) -> list:
    """(cluster, count, sum of each component) of the clusters that have vectors."""
    ddl = "cluster int, n long, sums array<long>"
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a component's sum stays below 2^63 for 2^36 rows of a task
        counts = np.zeros(len(pruner.centroids), np.int64)
        sums = np.zeros((len(pruner.centroids), dimensions), np.int64)
        for batch in batches:
            for _, whole, near in _read(batch, dimensions):
                cluster, _, _ = pruner.assign(whole, near)
                counts += np.bincount(cluster, minlength=len(counts))
                by = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[by], return_index=True)
                sums[present] += np.add.reduceat(whole[by].astype(np.int64), first, axis=0)
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array(counts[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))],
            schema=schema,
        )

    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    return vectors.mapInArrow(run, ddl).groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()


def _assigned(vectors: DataFrame, pruner: Pruner, dimensions: int) -> DataFrame:
    ddl = "vec_id long, cluster int, distance long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, whole, near in _read(batch, dimensions):
                cluster, square, _ = pruner.assign(whole, near)
                columns = [ids, pa.array(cluster.astype(np.int32)), pa.array(square)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return vectors.mapInArrow(run, ddl)


def cluster_vectors(
    embeddings: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
    pivots: int = PIVOTS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, and the last centroids."""
    spark = embeddings.sparkSession
    vectors = kept(embeddings, dimensions, scale)
    centroids = starts(vectors, clusters, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    fixed = choose_pivots(centroids, pivots)
    ready, path = written(_with_pivots(vectors, fixed, dimensions), "clustering-vectors")
    for _ in range(rounds):
        centroids = centroids.copy()
        for row in _sums(ready, Pruner(centroids, fixed), dimensions):
            # Python's division of whole numbers rounds down
            centroids[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dimensions)]
    assigned, _ = written(_assigned(ready, Pruner(centroids, fixed), dimensions), "clustering-assigned")
    discard(spark, path)
    return assigned, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The assigned vectors with sums over their cluster and over all, and the centroid's digest."""
    spark = assigned.sparkSession
    per = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(per.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, s, total, digest[c]) for c, s in per.items()]
    ddl = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    # one row per cluster
    return assigned.join(F.broadcast(spark.createDataFrame(rows, ddl)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
