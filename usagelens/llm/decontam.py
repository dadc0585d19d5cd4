"""Benchmark decontamination with a generalised suffix automaton of the test items.

The normalised words of all items go into one automaton. Training words stream through it;
the longest matching length and the state at each word tell which windows end there. Words
inside an occurrence of a window are hit; spans and documents beyond the limits are removed.

A test set is dealt to blocks of bounded size. Tasks build their automata and write them to the
shared folder; the tasks that scan load one block after the other, and spans are merged. A small
test set is one block.

Defined cases: a null or empty text has no words and is never hit; an item without words has
no window; repeated items and repeated documents are treated row by row; an item whose id is
null still hits and is named ``null``; windows that overlap or touch are one span; texts and
items are taken whole, whatever their length, a long item in overlapping pieces; empty tables give
empty results; other columns of the documents pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import arrow_schema, discard, in_parts, lean, read_table, written
from usagelens.session import work_dir

# A-Z to lower case; every other ASCII byte that is no word character to a space. Bytes of
# other characters belong to words.
_WORD_BYTES = bytes(
    b + 32
    if 65 <= b <= 90
    else b
    if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128
    else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")
WINDOW = 10


def words(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return [] if text is None else text.encode().translate(_WORD_BYTES).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items each state occurs in."""

    def __init__(self, items: Iterable[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.least = window
        coded = []
        for item, sequence in items:
            if sequence:
                codes = [self.ids.setdefault(w, len(self.ids)) for w in sequence]
                coded.append(("null" if item is None else str(item), codes))
                self.least = min(self.least, len(codes))
                state = 0
                for code in codes:
                    state = self._extend(state, code)
        self.items: list[set[str]] = [set() for _ in self.next]
        self.whole: dict[int, dict[int, set[str]]] = {}
        for item, codes in coded:
            state = 0
            for code in codes:
                state = up = self.next[state][code]
                while up > 0 and item not in self.items[up]:
                    self.items[up].add(item)
                    up = self.link[up]
            if len(codes) < window:
                self.whole.setdefault(state, {}).setdefault(len(codes), set()).add(item)

    def _extend(self, last: int, code: int) -> int:
        known = self.next[last].get(code)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, code, known)
        state = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][code]
            if self.length[target] != self.length[at] + 1:
                target = self._split(at, code, target)
            self.link[state] = target
        return state

    def _split(self, at: int, code: int, target: int) -> int:
        copy = self._state(dict(self.next[target]), self.length[at] + 1, self.link[target])
        self.link[target] = copy
        while at >= 0 and self.next[at].get(code) == target:
            self.next[at][code] = copy
            at = self.link[at]
        return copy

    def _state(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def stretches(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Where at least as many known words follow each other as the shortest window has.

        No window can occur elsewhere.
        """
        edge = np.flatnonzero(np.diff(np.concatenate(([0], codes >= 0, [0]))))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.least
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def scan(self, sequence: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """The merged word spans [start, end) of all window occurrences, and their items."""
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in sequence), np.int64, len(sequence))
        spans: list[list[int]] = []
        found: set[str] = set()
        for begin, end in self.stretches(codes):
            state = matched = 0
            for at, code in enumerate(codes[begin:end].tolist(), begin):
                while state and code not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if code in self.next[state]:
                    state = self.next[state][code]
                    matched += 1
                longest = self._windows(state, matched, found)
                if longest:
                    start = at + 1 - longest
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, at + 1])
        return spans, found

    def _windows(self, state: int, matched: int, found: set[str]) -> int:
        """The longest window that ends in this state; adds the items of all that do."""
        longest = 0
        while state > 0:
            below = self.length[self.link[state]]
            if matched >= self.window > below:
                found |= self.items[state]
                longest = self.window
            for size, items in self.whole.get(state, {}).items():
                if below < size <= matched:
                    found |= items
                    longest = max(longest, size)
            state, matched = self.link[state], below
        return longest


#: Bytes of words of a block, about; a state takes up to two words' worth of dictionaries and sets.
BLOCK_BYTES = 512 << 10
#: Bytes of documents that are held while the blocks pass, if there are several.
_HELD = 8 << 20


def _pieces(benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(item, words, size): the words of all items; a long item in pieces that share all but one
    of a window's words, so every window is in one of them."""
    ddl = "item string, words binary, size long"
    schema = arrow_schema(ddl)

    def parts(sequence: list[bytes]) -> Iterator[bytes]:
        begin, size = 0, 0
        for k, word in enumerate(sequence):
            size += len(word) + 1
            if size > block_bytes and k - begin >= max(window, 2):
                yield b" ".join(sequence[begin:k])
                begin = k - window + 1
                size = sum(map(len, sequence[begin : k + 1])) + window
        yield b" ".join(sequence[begin:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches):
            rows = [
                (item, part, len(part) + 1)
                for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                if (sequence := words(text))
                for part in parts(sequence)
            ]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item")
    return benchmark.select(item, F.col("text").cast("string").alias("text")).mapInArrow(run, ddl)


@dataclass(frozen=True)
class Blocks:
    """Automata of a test set in a shared folder, by number; a task loads one at a time."""

    folder: str
    numbers: tuple[int, ...]

    def load(self, block: int) -> Automaton:
        key = (self.folder, block)
        if key not in _LOADED:
            _LOADED.clear()  # one block in memory
            table = read_table(f"{self.folder}/block={block}", ["data"])
            _LOADED[key] = pickle.loads(table.column("data")[0].as_py())
        return _LOADED[key]


_LOADED: dict[tuple[str, int], Automaton] = {}


def build(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Automata of the items, built by tasks, one per block, and written to the shared folder.

    Items are dealt to blocks by a hash of their row, twice as many as their bytes ask for, so a block
    stays near its bound; the driver gets one sum.
    """
    spark = benchmark.sparkSession
    pieces, path = written(_pieces(benchmark, window, block_bytes), "test-items")
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    count = 1 if 0 < total <= block_bytes else -(-2 * total // block_bytes)
    folder, numbers = work_dir(spark, "llm-automata"), ()
    if count:

        def one(key: tuple, rows: pa.Table) -> pa.Table:
            items, texts = (rows.column(c).to_pylist() for c in ("item", "words"))
            found = Automaton(zip(items, (t.split() for t in texts), strict=True), window)
            data = pickle.dumps(found, pickle.HIGHEST_PROTOCOL)
            return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([data], pa.binary())})

        row = F.xxhash64("item", "words", F.monotonically_increasing_id())
        dealt = pieces.withColumn("block", F.pmod(row, F.lit(count)))
        built = dealt.groupBy("block").applyInArrow(one, "block long, data binary")
        built.write.partitionBy("block").parquet(folder)
        # one row per block that got items
        found = spark.read.schema("data binary, block long").parquet(folder).select("block").distinct()
        numbers = tuple(sorted(r["block"] for r in found.collect()))
    discard(spark, path)
    return Blocks(folder, numbers)


def automata(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> Iterator[Automaton]:
    """The automata of all blocks, one after the other."""
    blocks = build(benchmark, window, block_bytes)
    yield from (blocks.load(k) for k in blocks.numbers)


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _scanned(blocks: Blocks, texts: list[str | None]) -> list[tuple[int, list[list[int]], set[str]]]:
    """(words, merged spans, items) of each text; each block passes over all of them."""
    sequences = [words(t) for t in texts]
    found: list[tuple[list, set]] = [([], set()) for _ in texts]
    for number in blocks.numbers:
        block = blocks.load(number)
        for sequence, (spans, items) in zip(sequences, found, strict=True):
            more, named = block.scan(sequence)
            spans += more
            items |= named
    several = len(blocks.numbers) > 1
    return [
        (len(sequence), _merged(spans) if several else spans, items)
        for sequence, (spans, items) in zip(sequences, found, strict=True)
    ]


def _held(batches: Iterable[pa.RecordBatch], blocks: Blocks) -> Iterator[pa.RecordBatch]:
    """Small batches; larger ones if several blocks are to be loaded for each."""
    if len(blocks.numbers) < 2:
        yield from in_parts(batches)
        _LOADED.clear()  # a worker goes on with other tasks
        return
    held: list[pa.RecordBatch] = []
    for batch in in_parts(batches, 50):
        held.append(batch)
        if sum(b.nbytes for b in held) > _HELD:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    _LOADED.clear()


HITS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its words, words hit, items found and the digest of their ids."""
    blocks = build(benchmark, window)
    schema = arrow_schema(HITS)

    def run(batches):
        for batch in _held(batches, blocks):
            rows = []
            ids, texts = (c.to_pylist() for c in batch.columns)
            for doc, (n, spans, items) in zip(ids, _scanned(blocks, texts), strict=True):
                hit = sum(end - start for start, end in spans)
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                rows.append((doc, n, hit, len(items), digest, hit > 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                schema=schema,
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(lean(run), HITS)


def clean_text(text: str | None, spans: list[list[int]]) -> str | None:
    """The text without these word spans; what stood between their words goes with them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_WORD_BYTES))]
    out, after = [], 0
    for start, end in spans:
        out.append(raw[after : at[start][0]])
        after = at[end - 1][1]
    return b"".join([*out, raw[after:]]).decode()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    max_span: int = 0,
    max_coverage: float = 0.5,
) -> DataFrame:
    """The documents without test passages, all columns kept.

    Spans of over ``max_span`` hit words are cut out of the text (and ``n_chars``, if there is
    such a column, is set anew); a document of whose words more than ``max_coverage`` are hit
    is removed as a whole. Documents without hits pass unchanged.
    """
    blocks = build(benchmark, window)
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in _held(batches, blocks):
            texts = batch.column(place).to_pylist()
            keep, changed = [], {}
            for row, (text, (n, spans, _)) in enumerate(zip(texts, _scanned(blocks, texts), strict=True)):
                hit = sum(end - start for start, end in spans)
                keep.append(hit <= max_coverage * n)
                spans = [s for s in spans if s[1] - s[0] > max_span]
                if spans and keep[-1]:
                    changed[row] = clean_text(text, spans)
            columns = list(batch.columns)
            if changed:
                new = [changed.get(row, text) for row, text in enumerate(texts)]
                columns[place] = pa.array(new, batch.schema.field(place).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    old = columns[k].to_pylist()
                    counts = [len(changed[r]) if r in changed else n for r, n in enumerate(old)]
                    columns[k] = pa.array(counts, batch.schema.field(k).type)
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
