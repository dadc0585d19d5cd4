"""LM scoring by cross-entropy difference.

Two bigram models of the same order and smoothing share one vocabulary, that of the whole corpus:
the background model is trained on all documents, the target model on the documents labelled
good and not toxic. A document's score is the mean over its words of the target loss less the
background loss; the lower, the more it is like the target.

p(w | v) = (c(v, w) + SMOOTH / V) / (c(v) + SMOOTH), where v is the word before, or the start of the
document, c(v) its count as such, and V the number of distinct words, counted exactly. Losses are in bits. The loss of a word is log2(c(v) + SMOOTH) - log2(c(v, w) +
SMOOTH / V): one term of a context, one of a pair. So counts never meet each other or a text:

1. a task packs the pairs and the contexts of some documents, a *chunk*, into one row for each range
   of hashed keys; a key is there once, with the documents that have it and how often they do;
2. one range of all chunks gives the counts of its keys in both corpora, and at once each
   document's sum of their terms;
3. the sums of a chunk's documents are added up.

Counts are exact but for 48-bit hashes of pairs and contexts. The number of ranges follows the
corpus (``RANGE`` words in each). A key that many documents share is there once a chunk, with one
number per document of the chunk, not per occurrence; the task of its range holds these.

Defined cases: a null or blank text has no words, entropies and a difference of 0; labels that are
null or repeated count by their largest value (toxic: any); a null ``doc_id`` is scored and has
no label; repeated rows count each; empty tables give empty results, and without target
documents the target model is uniform; other columns are not read. One text is in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import arrow_schema, in_parts

SMOOTH = 64.0
#: Words of a chunk, and words whose keys are in one range, about.
CHUNK, RANGE = 4_000_000, 8_000_000
_SLICE = 1 << 23


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, split at ASCII white space, A-Z as a-z; a long text's slice by slice."""
    data = (text or "").encode().lower()
    at = 0
    while len(data) - at > _SLICE:
        end = at + _SLICE
        if not data[end - 1 : end].isspace():
            kept = data[at:end].rsplit(None, 1)
            if len(kept) < 2:  # no place to cut
                break
            end -= len(kept[1])
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def coded(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit keys of each word's context and pair. The start of a text is a context too."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)) for w in words(text)]
    after = np.concatenate(found)
    before = np.concatenate((np.zeros(1, np.uint64), after[:-1])) if len(after) else after
    mixed = (before * np.uint64(0x9E3779B97F4A7C15)) ^ after
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return before >> np.uint64(16), mixed >> np.uint64(16)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of bytes, the highest bytes first."""
    planes = numbers.astype(">u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


#: ``kind``: -1 a chunk's documents, 0 contexts, 1 pairs.
PACKED = "kind int, span long, chunk long, keys binary, posts binary, docs binary, times binary, goals binary"


def _pack(spans: int):
    """Contexts, of which fewer are distinct, have a quarter of the ranges of pairs."""
    schema = arrow_schema(PACKED)

    def ranges(kind: int, chunk: int, found: list[np.ndarray], goals: np.ndarray) -> Iterator[tuple]:
        """A row for each range of keys that the chunk has, keys in order: how many documents have
        each, which and how often, and how often target documents have it."""
        keys = np.concatenate(found)
        if not len(keys):
            return
        docs = np.repeat(np.arange(len(found)), [len(f) for f in found])
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], docs[order]
        fresh = np.concatenate(([True], keys[1:] != keys[:-1]))
        first = np.flatnonzero(fresh | np.concatenate(([True], docs[1:] != docs[:-1])))
        times, docs, fresh = np.diff(np.append(first, len(keys))), docs[first], np.flatnonzero(fresh[first])
        posts = np.diff(np.append(fresh, len(first)))
        distinct = keys[first[fresh]]
        target = np.add.reduceat(times * goals[docs], fresh)
        span = ((distinct >> np.uint64(16)) * np.uint64(spans if kind else 1 + spans // 4)) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1])))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(span)).tolist(), strict=True):
            start, end = fresh[a], fresh[b] if b < len(fresh) else len(first)
            steps = np.diff(distinct[a:b], prepend=np.uint64(0))
            parts = (steps, posts[a:b], docs[start:end], times[start:end], target[a:b])
            yield kind, int(span[a]), chunk, *map(packed, parts)

    def rows(chunk: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, goals, contexts, pairs = zip(*held, strict=True)
        goals = np.array(goals, np.int64)
        named = np.array([0 if i is None else i for i in ids], np.int64).view(np.uint64)
        known = packed(np.array([i is not None for i in ids], np.uint64))
        sizes = packed(np.array([len(p) for p in pairs], np.uint64))
        yield batch([(-1, chunk, chunk, packed(named), known, sizes, None, None)])
        yield from (batch([r]) for r in ranges(0, chunk, contexts, goals))
        yield from (batch([r]) for r in ranges(1, chunk, pairs, goals))

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for part in in_parts(batches):
            for doc, text, goal in zip(*(c.to_pylist() for c in part.columns), strict=True):
                held.append((doc, goal, *coded(text)))
                size += 1 + len(held[-1][-1])
                if size >= CHUNK:
                    yield from rows(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield from rows(chunk, held)

    return run


SUMS = "chunk long, kind int, ids binary, known binary, sizes binary, sums binary"


def _grouped(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of sorted batches by the values of some columns."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            at = [batch.schema.get_field_index(k) for k in keys]
            for k in range(batch.num_rows):
                row = tuple(c[k].as_py() for c in batch.columns)
                yield tuple(row[i] for i in at), row

    for key, found in groupby(rows(), key=lambda r: r[0]):
        yield key, (row for _, row in found)


def _sum(vocabulary: int):
    """Counts of each range's keys, and of each chunk's documents the sums of their terms."""
    schema = arrow_schema(SUMS)

    def row(*values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, _), found in _grouped(batches, "kind", "span"):
            if kind < 0:
                for _, _, chunk, ids, known, sizes, _, _ in found:
                    yield row(chunk, kind, ids, known, sizes, None)
                continue
            held, keys, alls, goals = [], [], [], []
            for _, _, chunk, steps, posts, docs, times, target in found:
                n = unpacked(posts).astype(np.int64)
                keys.append(np.cumsum(unpacked(steps), dtype=np.uint64))
                alls.append(np.add.reduceat(unpacked(times).astype(np.int64), np.cumsum(n) - n).astype(np.int32))
                goals.append(unpacked(target).astype(np.int32))
                held.append((chunk, posts, docs, times))
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            _, place = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            more = SMOOTH / vocabulary if kind else SMOOTH
            sign = -1.0 if kind else 1.0
            target, background = (
                sign * np.log2(np.bincount(place, np.concatenate(c)) + more) for c in (goals, alls)
            )
            del alls, goals
            for (chunk, posts, docs, times), own in zip(held, np.split(place, cuts), strict=True):
                n, doc = unpacked(posts).astype(np.int64), unpacked(docs).astype(np.int64)
                often = unpacked(times).astype(np.float64)
                some = np.flatnonzero(np.bincount(doc))
                # the difference is far smaller than the loss, so it is rounded by itself
                terms = (target[own], target[own] - background[own])
                sums = [np.bincount(doc, np.repeat(t, n) * often)[some].astype(np.float32) for t in terms]
                yield row(chunk, kind, packed(some), None, None, np.concatenate(sums).tobytes())

    return run


SCORES = "doc_id long, n_words long, target_entropy double, background_entropy double, difference double"


def _add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entropies of each chunk's documents; its row of documents comes first."""
    schema = arrow_schema(SCORES)
    for _, found in _grouped(batches, "chunk"):
        _, kind, ids, known, sizes, _ = next(found)
        if kind >= 0:
            raise ValueError("a chunk without its documents")
        n = unpacked(sizes).astype(np.int64)
        totals = np.zeros((2, len(n)))
        for _, _, some, _, _, sums in found:
            totals[:, unpacked(some).astype(np.int64)] += np.frombuffer(sums, np.float32).reshape(2, -1)
        target, difference = totals / np.maximum(1, n)
        names = pa.array(unpacked(ids).view(np.int64), pa.int64(), mask=unpacked(known) == 0)
        columns = [names, *map(pa.array, (n, target, target - difference, difference))]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): hashes of a task's words, each once a while, and how many words there were."""
    schema = arrow_schema("word long, n long")

    def batch(found: set[bytes], n: int) -> pa.RecordBatch:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)).view(np.int64)
        counts = np.zeros(len(found), np.int64)
        counts[:1] = n
        return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts)], schema=schema)

    found, n = set(), 0
    for part in in_parts(batches):
        for text in part.column(0).to_pylist():
            for some in words(text):
                found.update(some)
                n += len(some)
            if len(found) > 200_000:
                yield batch(found, n)
                found, n = set(), 0
    if found:
        yield batch(found, n)


def good_documents(labels: DataFrame) -> DataFrame:
    """The ids labelled good and not toxic."""
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .where("quality = 1 and coalesce(toxic, 0) = 0")
        .select("doc_id")
    )


def vocabulary(docs: DataFrame) -> tuple[int, int]:
    """The distinct words of all documents, and all words; one row for the driver.

    Each task sends every word once a while; hashes of 64 bits are told apart by grouping.
    """
    found = docs.select("text").mapInArrow(_distinct, "word long, n long")
    row = found.groupBy("word").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    return max(1, row[0]), row[1] or 0


def score(docs: DataFrame, targets: DataFrame, span: int = RANGE) -> DataFrame:
    """One row per document: its words, its entropy under both models and their difference.

    ``docs`` are read twice. Their labels come by one shuffle of the texts at any size; a broadcast
    would have no bound.
    """
    distinct, total = vocabulary(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = targets.select("doc_id").distinct().withColumn("target", F.lit(1))
    # sorted whole, so that a repeated task makes the same chunks
    marked = (
        texts.join(marks.hint("shuffle_hash"), "doc_id", "left")
        .select("doc_id", "text", F.coalesce("target", F.lit(0)).alias("target"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ranges = marked.mapInArrow(_pack(1 + total // span), PACKED)
    sums = (
        ranges.repartition("kind", "span").sortWithinPartitions("kind", "span", "chunk").mapInArrow(_sum(distinct), SUMS)
    )
    return sums.repartition("chunk").sortWithinPartitions("chunk", "kind", "ids").mapInArrow(_add, SCORES)
