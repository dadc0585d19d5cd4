"""Near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors of one label are dealt into shards of bounded size. Each shard builds its own graph;
every vector of the label searches every shard of it. A beam is widened for all queries until
audits against brute force find enough of the true links: one of the shard's own points, which do
not count as their own links, one of the queries that come from other shards. For a query alone it
is widened as long as it is full of links. Links inside a shard count for both ends, whichever found them. Candidates are verified by cosine in double precision, and links become
components.

Equal vectors of a label collapse to one class first, so a group of copies costs as much as
one vector; a class counts its copies as links of each other.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and
vectors without a label, link with nothing and are kept; vectors of different lengths never
link; repeated rows are vectors of their own; a null ``vec_id`` takes part, names a component
only if it has no other id (then null) and is not kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import arrow_schema, components, written

LEAST_COSINE = 0.93
#: Vectors of a shard at most, about.
SHARD = 8192
#: Links of a vector on an upper level; twice as many on the lowest.
DEGREE = 12
BEAM = 32
#: Queries of a shard held against brute force, and the share of their links to be found.
AUDIT, RECALL = 64, 0.99
#: An audit takes more queries until they have as many links as that, but not more than these.
MOST_AUDITED = 1024
_QUERIES = 512
#: What single precision may lose of a cosine.
_ROUNDING = 1e-5


class Graph:
    """A navigable small-world graph of several levels over unit vectors.

    Points enter in batches that double in size: a batch searches the graph so far, and its
    points see each other too. All searches of a batch walk at the same time on arrays.
    """

    def __init__(self, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM):
        self.unit, self.beam = unit.astype(np.float32), beam  # verified in double precision later
        n = len(unit)
        # Levels by position, which is by hash: a point in DEGREE is on the next level too.
        order = np.arange(n)
        self.levels: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        points = order
        while True:
            self.levels.append(points)
            if len(points) <= 4 * degree:
                break
            points = points[::degree]
        self.near = [np.full((n, 2 * degree), -1, np.int32) for _ in self.levels]
        for level in range(len(self.levels) - 1, -1, -1):
            self._build(level, degree if level else 2 * degree)

    def _build(self, level: int, degree: int) -> None:
        points, done = self.levels[level], 4 * DEGREE
        self._connect(level, points[:done], None, degree)
        while done < len(points):
            batch = points[done : 2 * done]
            for at in range(0, len(batch), _QUERIES):
                some = batch[at : at + _QUERIES]
                entry = self._entries(self.unit[some], level)
                found, _ = self._walk(self.unit[some], level, entry, self.beam)
                self._connect(level, some, found, degree)
            done = 2 * done

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The nearest points found on the level above, or some points of the lowest batch."""
        if level + 1 >= len(self.levels):
            return np.tile(self.levels[level][:8], (len(queries), 1))
        entry = self._entries(queries, level + 1)
        found, _ = self._walk(queries, level + 1, entry, 8)
        return np.where(found >= 0, found, self.levels[level][0])

    def _connect(self, level: int, some: np.ndarray, found: np.ndarray | None, degree: int) -> None:
        """Links a batch with what its search found and with its own nearest, in both directions."""
        own = self.unit[some] @ self.unit[some].T
        np.fill_diagonal(own, -2)
        k = min(degree, len(some) - 1)
        if k > 0:
            best = np.argpartition(-own, k - 1, axis=1)[:, :k]
            near = some[best]
        else:
            near = np.full((len(some), 1), -1)
        if found is not None:
            near = np.concatenate([found, near], axis=1)
        self._keep(level, np.repeat(some, near.shape[1]), near.ravel(), degree)

    def _keep(self, level: int, a: np.ndarray, b: np.ndarray, degree: int) -> None:
        """Adds links a-b; each end keeps half of its places for its nearest and the rest for
        a spread over what lies farther."""
        ok = (b >= 0) & (a != b)
        a, b = np.concatenate([a[ok], b[ok]]), np.concatenate([b[ok], a[ok]])
        ends = np.unique(a)
        old = self.near[level][ends]
        a = np.concatenate([a, np.repeat(ends, old.shape[1])])
        b = np.concatenate([b, old.ravel()])
        ok = b >= 0
        pair = np.unique(a[ok].astype(np.int64) * len(self.unit) + b[ok])
        a, b = pair // len(self.unit), pair % len(self.unit)
        close = np.concatenate(
            [np.einsum("ij,ij->i", self.unit[a[s : s + 65536]], self.unit[b[s : s + 65536]]) for s in range(0, len(a), 65536)]
            or [np.empty(0)]
        )
        order = np.lexsort((-close, a))
        a, b = a[order], b[order]
        start = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        sizes = np.diff(np.append(start, len(a)))
        rank = np.arange(len(a)) - np.repeat(start, sizes)
        size = np.repeat(sizes, sizes)
        half = degree // 2
        # ranks half, half + step, half + 2 step ... of the farther ones
        step = np.maximum(1, -(-(size - half) // (degree - half)))
        kept = (rank < half) | ((rank - half) % step == 0)
        place = np.where(rank < half, rank, half + (rank - half) // step)
        kept &= place < degree
        self.near[level][ends] = -1
        self.near[level][a[kept], place[kept]] = b[kept]

    def _walk(self, queries: np.ndarray, level: int, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, cosines) of each query's beam, nearest first; -1 where there are fewer."""
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(self.unit)), bool)
        ids = np.full((len(queries), beam), -1, np.int64)
        close = np.full((len(queries), beam), -2.0, np.float32)
        open_ = np.zeros((len(queries), beam), bool)
        fresh = entry
        active = rows[:, 0]
        while True:
            # each new point once
            fresh = np.sort(fresh, axis=1)
            new = fresh >= 0
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            new &= ~seen[active[:, None], np.maximum(fresh, 0)]
            q, c = np.nonzero(new)
            seen[active[q], fresh[q, c]] = True
            cos = np.full(fresh.shape, -2.0, np.float32)
            cos[q, c] = np.einsum("ij,ij->i", queries[active[q]], self.unit[fresh[q, c]])
            all_ids = np.concatenate([ids[active], np.where(new, fresh, -1)], axis=1)
            all_close = np.concatenate([close[active], cos], axis=1)
            all_open = np.concatenate([open_[active], new], axis=1)
            best = np.argsort(-all_close, axis=1)[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            close[active] = np.take_along_axis(all_close, best, 1)
            open_[active] = np.take_along_axis(all_open, best, 1)
            active = active[open_[active].any(axis=1)]
            if not len(active):
                return ids, close
            # the four nearest open points of each beam are looked at in one step
            place = np.where(open_[active], np.arange(beam, dtype=np.int32), beam)
            next_ = np.argpartition(place, 3, axis=1)[:, :4]
            looked = np.where(np.take_along_axis(open_[active], next_, 1), np.take_along_axis(ids[active], next_, 1), -1)
            open_[active[:, None], next_] = False
            around = self.near[level][np.maximum(looked, 0)]
            fresh = np.where(looked[:, :, None] >= 0, around, -1).reshape(len(active), -1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        queries = queries.astype(np.float32)
        return self._walk(queries, 0, self._entries(queries, 0), beam)


class Shard:
    """The graph of one shard, with the beam that its audit asks for."""

    def __init__(self, vectors: np.ndarray, least: float = LEAST_COSINE):
        self.unit = unit_rows(vectors)
        self.least = least
        self.graph = Graph(self.unit) if len(vectors) > 8 * DEGREE else None
        self.beam = BEAM
        self.recall = 1.0
        #: links that the audits counted, and how many of them were found
        self.true = self.hits = 0
        if self.graph:
            self.audit(self.unit, own=True)

    def audit(self, queries: np.ndarray, own: bool = False) -> None:
        """Widens the beam until enough of the links of some queries are found.

        Queries are taken evenly, more of them while they have few links, and held against brute
        force. If they are the shard's ``own`` points, a point does not count as its own link.
        """
        if self.graph is None or not len(queries):
            return
        n, true, some = AUDIT, [], np.empty(0, np.int64)
        while True:
            some = np.unique(np.linspace(0, len(queries) - 1, n).astype(np.int64))
            true = [np.flatnonzero(row >= self.least) for row in queries[some] @ self.unit.T]
            if own:
                true = [t[t != q] for q, t in zip(some, true, strict=True)]
            if sum(map(len, true)) >= AUDIT or n >= min(len(queries), MOST_AUDITED):
                break
            n *= 4
        total = sum(map(len, true))
        while total:
            got = self.links(queries[some])
            hits = sum(len(np.intersect1d(g, t)) for g, t in zip(got, true, strict=True))
            if hits >= RECALL * total or 8 * self.beam >= len(self.unit):
                self.true, self.hits = self.true + total, self.hits + hits
                self.recall = self.hits / self.true
                return
            self.beam *= 2

    def links(self, queries: np.ndarray) -> list[np.ndarray]:
        """The points of the shard whose cosine with each query is enough.

        A beam full of links is widened; one as wide as an eighth of the shard is no cheaper than
        the shard itself.
        """
        out: list = [None] * len(queries)
        todo, beam = np.arange(len(queries)), self.beam
        while len(todo):
            again = []
            for at in range(0, len(todo), _QUERIES):
                some = todo[at : at + _QUERIES]
                if self.graph is None or 8 * beam >= len(self.unit):
                    for q, row in zip(some, queries[some] @ self.unit.T, strict=True):
                        out[q] = np.flatnonzero(row >= self.least)
                    continue
                ids, close = self.graph.search(queries[some], beam)
                for q, i, c in zip(some.tolist(), ids, close, strict=True):
                    near = i[c >= self.least - _ROUNDING]
                    if len(near) == beam:
                        again.append(q)
                    else:
                        out[q] = near[self.unit[near] @ queries[q] >= self.least] if len(near) else near
            todo, beam = np.array(again, np.int64), 4 * beam
        return out


def _both_ways(links: list[np.ndarray]) -> list[np.ndarray]:
    """Links of n points, each also in the list of its other end."""
    n = len(links)
    a, b = np.repeat(np.arange(n), [len(x) for x in links]), np.concatenate([*links, np.empty(0, np.int64)]).astype(np.int64)
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
    return np.split(pairs % n, np.searchsorted(pairs // n, np.arange(1, n)))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt(np.einsum("ij,ij->i", wide, wide))[:, None]


def _roots(n: int, links: list[np.ndarray]) -> np.ndarray:
    """The smallest point each of n points is connected with."""
    root = np.arange(n)

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, near in enumerate(links):
        if len(near) > 1 or len(near) == 1 and near[0] != a:
            tops = {top(int(x)) for x in near} | {top(a)}
            low = min(tops)
            for x in tops:
                root[x] = low
    return np.array([top(x) for x in range(n)], np.int64)


FOUND = "class long, n_links long, other long"


def _search(least: float):
    """For rows sorted by shard, its own points first: the links of every query.

    A row per query with links: their number, and one point of each of the shard's components that
    it links with. Only one shard's points and one batch of queries are in memory.
    """
    schema = arrow_schema(FOUND)

    def answers(found: list[np.ndarray], asked: np.ndarray, root: np.ndarray, ids: np.ndarray, copies: np.ndarray):
        rows = []
        for q, near in zip(asked.tolist(), found, strict=True):
            others = near[ids[near] != q]
            if len(others):
                count = int(copies[others].sum())
                for k, end in enumerate(np.unique(root[others]).tolist()):
                    rows.append((q, count if k == 0 else 0, int(ids[end])))
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
        )

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column("embedding")
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, held, audited = None, None, [], False
        root = ids = copies = np.empty(0, np.int64)

        def build() -> pa.RecordBatch:
            """The shard of the points held, and the links of its own points."""
            nonlocal shard, root, ids, copies
            ids, copies = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("class", "copies"))
            shard = Shard(np.concatenate([matrix(h) for h in held]), least)
            found = _both_ways(shard.links(shard.unit))
            root = _roots(len(ids), found)
            return answers(found, ids, root, ids, copies)

        for batch in batches:
            keys = batch.column("bucket").to_numpy(zero_copy_only=False)
            query = batch.column("query").to_numpy(zero_copy_only=False).astype(bool)
            cut = np.flatnonzero((keys[1:] != keys[:-1]) | (query[1:] != query[:-1])) + 1
            for start, end in zip([0, *cut], [*cut, len(keys)], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if keys[start] != key:
                    if held and shard is None:
                        yield build()
                    key, shard, held, audited = keys[start], None, [], False
                if not query[start]:
                    held.append(part)
                    continue
                if shard is None:
                    yield build()
                if not audited:
                    # by the hash of their class, so the first are like any others
                    shard.audit(unit_rows(matrix(part.slice(0, MOST_AUDITED))))
                    audited = True
                for at in range(0, part.num_rows, _QUERIES):
                    some = part.slice(at, _QUERIES)
                    yield answers(shard.links(unit_rows(matrix(some))), some.column("class").to_numpy(), root, ids, copies)
        if held and shard is None:
            yield build()

    return run


def _can_link() -> Column:
    """Whether a vector has a label and a direction."""
    vector = F.col("embedding").cast("array<float>")
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = F.col("label").isNotNull() & finite & F.exists(vector, lambda x: F.coalesce(x != 0, F.lit(False)))
    return F.coalesce(fit, F.lit(False))


def valid(embeddings: DataFrame) -> DataFrame:
    """(label, embedding, vec_id) of the vectors that can link; -0.0 becomes 0.0."""
    vector = F.col("embedding").cast("array<float>")
    return embeddings.where(_can_link()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.transform(vector, lambda x: x + F.lit(0.0).cast("float")).alias("embedding"),
    )


def near_duplicates(embeddings: DataFrame, least: float = LEAST_COSINE, shard: int = SHARD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    vectors = valid(embeddings)
    # One row per distinct vector, numbered once and written with its number.
    classes = (
        vectors.groupBy("label", "embedding")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
        .withColumn("class", F.monotonically_increasing_id())
        .withColumn("width", F.size("embedding"))
    )
    classes, _ = written(classes, "hnsw-classes")
    sizes, _ = written(
        classes.groupBy("label", "width").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards")), "hnsw-sizes"
    )
    dealt = classes.join(sizes, ["label", "width"])
    own = F.pmod(F.xxhash64("class", F.lit(1)), F.col("shards"))
    bucket = F.xxhash64("label", "width", F.col("s").cast("long"))
    columns = ["bucket", "query", "class", "copies", "embedding"]
    points = dealt.withColumn("s", own).withColumn("bucket", bucket).withColumn("query", F.lit(0)).select(columns)
    asked = (
        dealt.withColumn("own", own)
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .where("s <> own")  # a shard asks for its own points itself
        .withColumn("bucket", bucket)
        .withColumn("query", F.lit(1))
        .select(columns)
    )
    found, _ = written(
        points.union(asked)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "query", F.xxhash64("class"))
        .mapInArrow(_search(least), FOUND),
        "hnsw-links",
    )
    counts = found.groupBy("class").agg(F.sum("n_links").alias("links"))
    groups = components(found.select(F.col("class").alias("a"), F.col("other").alias("b")), "hnsw-components")
    rooted, _ = written(
        classes.select("class", "label", "embedding", "copies", "least_id")
        .join(counts, "class", "left")
        .join(groups.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
        .withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1),
        "hnsw-rooted",
    )
    least_ids, _ = written(rooted.groupBy("root").agg(F.min("least_id").alias("component")), "hnsw-least")
    named, _ = written(
        rooted.join(least_ids, "root").select("label", "embedding", "links", "component"), "hnsw-named"
    )
    linked = (
        vectors.join(named, ["label", "embedding"])
        .select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    )
    alone = embeddings.where(~_can_link()).select(F.col("vec_id").cast("long").alias("vec_id"))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
