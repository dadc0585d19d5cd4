"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority of the XXH64 values of a text's three-word shingles.
Two fingerprints that differ in at most three bits differ in at most two bits outside some
16-bit block, so they meet half way: with that block masked, both have a variant within one
flipped bit that is the same. Every distinct fingerprint emits these variants for each of
the four blocks (4 x 49), they are shuffled on the variant, and what collides is verified on
all 64 bits. A bucket reports, for each member, one that verified links connect it with, never
all its pairs.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other;
repeated rows and ids give one row each; a null ``doc_id`` keeps its row, but names a
component only if it has no other id (then null); a bit that is set in exactly half the
shingles is 0; texts are taken whole, whatever their length; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelens.llm.common import arrow_schema, components, in_parts, lean, written

SEED = 42
RADIUS = 3
_BLOCK = 1 << 16
# Buckets up to this size are compared by shifted arrays, larger ones by search from member to member.
_SHIFTS = 48


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a whole text."""
    found = [] if text is None else text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    last = ends[min(shingle, len(found)) - 1 :] - 1
    first = np.concatenate(([0], ends[: len(last) - 1]))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), _BLOCK):
        bounds = zip(first[at : at + _BLOCK].tolist(), last[at : at + _BLOCK].tolist(), strict=True)
        values = np.array([digest(joined[s:e], SEED) for s, e in bounds], "<u8")
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = np.packbits(2 * counts > len(last), bitorder="little")
    return int(set_.view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fp) of every row and more long columns; fp is the fingerprint as a signed long."""
    ddl = ", ".join(f"{n} long" for n in ("doc_id", "fp", *more))
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            known: dict[str | None, int] = {}
            values = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = fingerprint(text)
                values.append(known[text])
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(lean(run), ddl)


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fp) of all variants: each block masked, at most one other bit flipped."""
    keys = []
    for block in range(4):
        place = np.uint64(16 * block)
        mask = np.uint64(0xFFFF) << place
        flips = [np.uint64(0)] + [np.uint64(1) << np.uint64(p) for p in range(64) if p // 16 != block]
        base = (fps & ~mask) | (np.uint64(0x8001 + 2 * block) << place)  # the block's number, where it is masked
        keys.append((base[:, None] ^ np.array(flips, np.uint64)[None, :]).ravel())
    return np.concatenate(keys), np.tile(np.repeat(fps, 49), 4)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of n nodes is connected with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _search(fps: np.ndarray) -> np.ndarray:
    """As ``_forest``, for one large bucket: from member to member, over those not yet reached."""
    label = np.arange(len(fps))
    rest = np.arange(len(fps))
    while len(rest):
        root, rest = rest[0], rest[1:]
        front = [root]
        while front and len(rest):
            near = _close(fps[rest], fps[front.pop()])
            reached = rest[near]
            label[reached] = root
            front.extend(reached.tolist())
            rest = rest[~near]
    return label


def links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member that verified links in a bucket connect it with); keys are sorted."""
    same = keys[1:] == keys[:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    keys, fps = keys[several], fps[several]
    if not len(keys):
        return fps, fps
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(start, len(keys)))
    bucket = np.repeat(np.arange(len(start)), sizes)
    small = np.repeat(sizes <= _SHIFTS, sizes)
    a, b = [], []
    for shift in range(1, int(sizes[sizes <= _SHIFTS].max(initial=1))):
        i = np.flatnonzero((bucket[shift:] == bucket[:-shift]) & small[:-shift])
        i = i[_close(fps[i], fps[i + shift])]
        a.append(i)
        b.append(i + shift)
    label = _forest(len(fps), np.concatenate(a or [start[:0]]), np.concatenate(b or [start[:0]]))
    for at, size in zip(start[sizes > _SHIFTS].tolist(), sizes[sizes > _SHIFTS].tolist(), strict=True):
        label[at : at + size] = at + _search(fps[at : at + size])
    linked = np.flatnonzero(label != np.arange(len(label)))
    pair = np.unique(np.stack([fps[linked], fps[label[linked]]], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("key long, fp long")
    for batch in in_parts(batches, 2000):
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, owners = variants(fps)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(owners.view(np.int64))], schema=schema
        )


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole buckets; the last bucket of a batch waits for the next one.

    A bucket has at most 49 x 65,536 fingerprints, whatever the corpus.
    """
    schema = arrow_schema("a long, b long")
    held = [np.empty(0, np.int64), np.empty(0, np.int64)]

    def found(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = links(keys, fps.view(np.uint64))
        if len(a):
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema
            )

    for batch in batches:
        held = [
            np.concatenate([h, c.to_numpy(zero_copy_only=False)])
            for h, c in zip(held, batch.columns, strict=True)
        ]
        if len(held[0]):
            cut = int(np.searchsorted(held[0], held[0][-1]))
            yield from found(held[0][:cut], held[1][:cut])
            held = [h[cut:] for h in held]
    yield from found(*held)


def near_duplicates(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_fp) and more long columns, one row per document.

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most three bits,
    ``component_fp`` one fingerprint that names the component.
    Copies collapse to their fingerprint before anything is emitted, so a group of copies
    costs as much as one document.
    """
    rows, _ = written(fingerprints(docs, *more), "simhash-fp")
    distinct, _ = written(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    edges = (
        distinct.select("fp")
        .mapInArrow(lean(_emit), "key long, fp long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(lean(_meet), "a long, b long")
    )
    groups = components(edges, "simhash-components").withColumnRenamed("node", "fp")
    named, _ = written(
        distinct.join(groups, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")),
        "simhash-roots",
    )
    smallest, _ = written(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-smallest")
    classes, _ = written(named.join(smallest, "root").select("fp", "root", "component_id"), "simhash-classes")

    def text_of(name: str):
        return F.lpad(F.lower(F.hex(name)), 16, "0")

    return rows.join(classes, "fp").select(
        "doc_id",
        text_of("fp").alias("fingerprint"),
        "component_id",
        text_of("root").alias("component_fp"),
        *more,
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns kept: the one with its smallest ``doc_id``.

    Of the component's rows with that id, the one with the smallest XXH64 of its text stays; other
    components that the id occurs in keep a row of their own. In a component without any id the
    smallest text stays; such rows are found by their fingerprint.
    """
    mark, order = "__simhash_mark", "__simhash_order"
    marked = docs.withColumn(mark, F.xxhash64("text"))
    near = near_duplicates(marked, mark)
    chosen = (
        near.where("doc_id is not null")
        .groupBy("component_fp")
        .agg(F.min(F.struct("doc_id", mark)).alias("one"))
        .select("one.doc_id", f"one.{mark}")
    )
    kept = marked.where("doc_id is not null").join(chosen, ["doc_id", mark], "left_semi")
    first = Window.partitionBy("doc_id", mark).orderBy("text")
    kept = kept.withColumn(order, F.row_number().over(first)).where(F.col(order) == 1).select(docs.columns)
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return kept
    return kept.unionByName(_keep_nameless(nameless, near))


def _keep_nameless(nameless: DataFrame, near: DataFrame) -> DataFrame:
    """Of rows without id, those whose component has no id either: one row per component."""
    free = near.where("component_id is null").select("fingerprint", "component_fp").distinct()
    chosen = (
        nameless.select("text")
        .distinct()
        .mapInArrow(lean(_with_fingerprint), "text string, fingerprint string")
        .join(free, "fingerprint")
        .groupBy("component_fp")
        .agg(F.min(F.struct(F.col("text").isNotNull(), "text")).alias("t"))
        .select(F.col("t.text").alias("__simhash_text"))
    )
    same = nameless["text"].eqNullSafe(chosen["__simhash_text"])
    return nameless.join(chosen, same, "left_semi").dropDuplicates(["text"]).select(nameless.columns)


def _with_fingerprint(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = arrow_schema("text string, fingerprint string")
    for batch in in_parts(batches):
        marks = [f"{fingerprint(t):016x}" for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], schema=schema)
