"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array.

A run is a stretch of words that repeats with a smallest period q, of at least ``LEAST_WORDS``
words and ``LEAST_TIMES`` periods, and that no neighbouring word extends. Every run of period q
and end e has exactly one square at its right end that branches: the suffixes at e - 2q and e - q
agree on q words and no more. Such a pair lies in one LCP interval of depth q, in two of its
children, so of each interval only the suffixes outside its largest child are looked up:
is ISA[i + q] or ISA[i - q] inside the interval, too? What is found is rotated to the left
as far as the words allow, and squares of one stretch are merged into its smallest period. The
intervals come from one pass over the LCP array with a stack; no tree is built.

Before that, words that cannot be in a run are set aside: each eight neighbouring words of a
run occur in it a second time (length - 2 q is eight or more), so only stretches of words whose
groups of eight recur in the same text go to the suffix array. A hash tells which recur; an
accidental equality only lets more words through.

Work per text: n log n for the suffix array (prefix doubling over what is not yet sorted) and for
the smaller children, n for the rest. Texts are taken whole, whatever their length; short
ones are worked on together, in parts of ``PART_BYTES`` of text, a longer one alone.

Defined cases: a null, empty or blank text has no words, no runs, and an empty collapsed text;
repeated rows and ids give one row each; a null ``doc_id`` is kept; runs come by start, then
period; an empty table gives no rows; other columns are not read by ``find_runs`` and pass
through ``collapse`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_TIMES = 3
# Text worked on together; bounds the memory of a task beside its longest text.
PART_BYTES = 4_000_000
WORD = r"[^\x20\x09-\x0D]+"
RUNS_DDL = "array<struct<start:long,length:long,period:long>>"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by prefix doubling; the last symbol occurs once."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    first = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = begin
    # places of the suffix array whose group has more than one suffix
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    depth = 1
    while len(open_):
        suffixes = order[open_]
        # a suffix of a group ends behind this depth: symbols that occur once end each group
        key = rank[suffixes] * n + rank[suffixes + depth]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[open_] = suffixes
        first = np.concatenate(([True], key[1:] != key[:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(len(open_)), 0))
        rank[suffixes] = open_[begin]
        open_ = open_[~(first & np.append(first[1:], True))]
        depth *= 2
    return order, rank


def common_prefixes(symbols: list, order: list, rank: list) -> list:
    """LCP of each suffix with the one before it in order; the last symbol occurs once."""
    out = [0] * len(symbols)
    h = 0
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            while symbols[i + h] == symbols[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def small_children(lcp: list) -> np.ndarray:
    """Rows (begin, end, interval begin, interval end, depth) of all children of LCP intervals
    but the largest of each; ends are exclusive."""
    found: list[tuple[int, int, int, int, int]] = []
    depths, begins, cuts = [0], [0], [[]]
    n = len(lcp)
    for k in range(1, n + 1):
        depth = lcp[k] if k < n else 0
        begin = k - 1
        while depths[-1] > depth:
            own, begin, inner = depths.pop(), begins.pop(), cuts.pop()
            bounds = [begin, *inner, k]
            sizes = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
            largest = sizes.index(max(sizes))
            for c, size in enumerate(sizes):
                if c != largest:
                    found.append((bounds[c], bounds[c] + size, begin, k, own))
        if depths[-1] < depth:
            depths.append(depth)
            begins.append(begin)
            cuts.append([k])
        elif depth:
            cuts[-1].append(k)
    return np.array(found, np.int64).reshape(-1, 5)


def branching_squares(order: np.ndarray, rank: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, root length) of all squares that the next word does not rotate."""
    if not len(children):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(order)
    sizes = children[:, 1] - children[:, 0]
    row = np.repeat(np.arange(len(children)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + children[row, 0]
    suffix, depth = order[place], children[row, 4]
    begins, roots = [], []
    for step in (1, -1):
        other = suffix + step * depth
        inside = np.flatnonzero((other >= 0) & (other < n))
        r, of = rank[other[inside]], children[row[inside]]
        hit = (r >= of[:, 2]) & (r < of[:, 3]) & ((r < of[:, 0]) | (r >= of[:, 1]))
        begins.append(np.minimum(suffix, other)[inside[hit]])
        roots.append(depth[inside[hit]])
    pairs = np.unique(np.stack([np.concatenate(begins), np.concatenate(roots)]), axis=1)
    return pairs[0], pairs[1]


def _rotated(symbols: np.ndarray, begin: int, root: int) -> int:
    """Where the stretch of this period that holds the square begins."""
    block = 16
    while begin:
        size = min(block, begin)
        differ = np.flatnonzero(symbols[begin - size : begin] != symbols[begin - size + root : begin + root])
        if len(differ):
            return begin - size + int(differ[-1]) + 1
        begin -= size
        block *= 2
    return 0


def periodic_runs(symbols: np.ndarray, words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(begin, end, smallest period) of all runs; the last symbol occurs once."""
    order, rank = suffix_array(symbols)
    lcp = common_prefixes(symbols.tolist(), order.tolist(), rank.tolist())
    begins, roots = branching_squares(order, rank, small_children(lcp))
    ends = begins + 2 * roots
    by = np.lexsort((roots, ends))
    found: list[tuple[int, int, int]] = []
    end, here = -1, []
    for b, q, e in zip(begins[by].tolist(), roots[by].tolist(), ends[by].tolist(), strict=True):
        if e != end:
            end, here = e, []
        # a multiple of a period that the same stretch has already
        if any(q % period == 0 and b >= start for start, period in here):
            continue
        start = _rotated(symbols, b, q)
        here.append((start, q))
        if e - start >= max(words, times * q):
            found.append((start, e, q))
    return found


class _Words:
    """The words of a few texts as codes: equal words have equal codes."""

    def __init__(self, texts: pa.Array) -> None:
        column = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, np.uint8) if buffer else np.zeros(0, np.uint8)
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        blank = _SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin, end = ~blank, ~blank
        begin[1:] &= blank[:-1] | edge[1:-1]
        end[:-1] &= blank[1:] | edge[1:-1]
        starts = np.flatnonzero(begin)
        self.sizes = np.flatnonzero(end) + 1 - starts
        self.dense = data[~blank]
        self.n = len(starts)
        #: the first word of each text, and the number of words
        self.first = np.searchsorted(starts, offsets)
        ends = np.concatenate(([0], np.cumsum(self.sizes)))
        buffers = [None, pa.py_buffer(ends), pa.py_buffer(self.dense)]
        coded = pa.Array.from_buffers(pa.large_binary(), self.n, buffers).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.text = np.repeat(np.arange(len(column)), np.diff(self.first))

    def joined(self, keep: np.ndarray) -> pa.Array:
        """The kept words of each text, joined by one space."""
        sizes, text = self.sizes[keep], self.text[keep]
        n = len(self.first) - 1
        words = np.bincount(text, minlength=n)
        chars = np.bincount(text, weights=sizes, minlength=n).astype(np.int64)
        offsets = np.concatenate(([0], np.cumsum(chars + np.maximum(words - 1, 0))))
        out = np.full(int(offsets[-1]), 0x20, np.uint8)
        filled = np.cumsum(words > 0)[text] - 1
        shift = np.arange(len(sizes)) - filled
        dense = self.dense if keep.all() else self.dense[np.repeat(keep, self.sizes)]
        out[np.arange(len(dense)) + np.repeat(shift, sizes)] = dense
        return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def candidate_stretches(codes: np.ndarray, text: np.ndarray, words: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of all stretches that can hold a run, each in one text."""
    # length - 2 q of the shortest run: all groups of so many words recur in a run
    group = min(max(words - 2 * q, (times - 2) * q) + 1 for q in range(1, words + 1))
    none = np.zeros(0, np.int64)
    if len(codes) < words:
        return none, none
    if group < 2 or times < 3:
        recurs = np.ones(len(codes), bool)
    else:
        group = min(group, 8)
        value = _mixed(codes) + _mixed(text) * np.uint64(3)
        hashed = value[: len(codes) - group + 1].copy()
        for k in range(1, group):
            hashed *= np.uint64(0x9E3779B97F4A7C15)
            hashed += value[k : k + len(hashed)]
        whole = text[: len(hashed)] == text[group - 1 :]
        hashed, at = hashed[whole], np.flatnonzero(whole)
        sorted_ = np.sort(hashed)
        twice = sorted_[1:][sorted_[1:] == sorted_[:-1]]
        if not len(twice):
            return none, none
        twice = twice[np.concatenate(([True], twice[1:] != twice[:-1]))]
        near = np.minimum(np.searchsorted(twice, hashed), len(twice) - 1)
        at = at[twice[near] == hashed]
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + group, -1)
        recurs = np.cumsum(cover[:-1]) > 0
    before = np.concatenate(([False], recurs[:-1] & (text[1:] == text[:-1])))
    after = np.concatenate((recurs[1:] & (text[1:] == text[:-1]), [False]))
    begins, ends = np.flatnonzero(recurs & ~before), np.flatnonzero(recurs & ~after) + 1
    long_ = ends - begins >= words
    return begins[long_], ends[long_]


def runs_of(words: _Words, least: int, times: int) -> np.ndarray:
    """Rows (text, begin, end, period) by text, begin, period; begins and ends among all words."""
    begins, ends = candidate_stretches(words.codes, words.text, least, times)
    if not len(begins):
        return np.zeros((0, 4), np.int64)
    sizes = ends - begins + 1
    at = np.cumsum(sizes) - sizes
    # each stretch has symbols of its own, and a last one that occurs once
    stretch = np.repeat(np.arange(len(begins)), sizes)
    source = np.arange(len(stretch)) - at[stretch] + begins[stretch]
    last = source == ends[stretch]
    width = int(words.codes.max()) + 2
    codes = np.where(last, width - 1, words.codes[np.minimum(source, words.n - 1)])
    found = periodic_runs(np.unique(stretch * width + codes, return_inverse=True)[1], least, times)
    rows = [(int(words.text[source[b]]), int(source[b]), int(source[e - 1]) + 1, q) for b, e, q in found]
    rows.sort(key=lambda r: (r[1], r[3]))
    return np.array(rows, np.int64).reshape(-1, 4)


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of parts of some MB of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for k, more in enumerate(sizes.tolist()):
        if k > begin and size + more > PART_BYTES:
            yield begin, k
            begin, size = k, 0
        size += more
    if begin < len(sizes):
        yield begin, len(sizes)


def _scan(least: int, times: int, place: int, schema: pa.Schema):
    """Batches with a text column at this place: the others, the collapsed texts, the runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place)
            for low, high in _parts(texts):
                words = _Words(texts.slice(low, high - low))
                found = runs_of(words, least, times)
                keep = np.ones(words.n, bool)
                for _, begin, end, q in found.tolist():
                    keep[begin + q : end] = False
                starts = found[:, 1] - words.first[found[:, 0]]
                values = [starts, found[:, 2] - found[:, 1], found[:, 3]]
                structs = pa.StructArray.from_arrays([pa.array(v) for v in values], fields=list(_RUN))
                offsets = np.searchsorted(found[:, 0], np.arange(high - low + 1)).astype(np.int32)
                runs = pa.ListArray.from_arrays(pa.array(offsets), structs)
                rest = [c.slice(low, high - low) for k, c in enumerate(batch.columns) if k != place]
                collapsed = words.joined(keep).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rest, collapsed, runs.cast(schema.field(-1).type)], schema=schema)

    return run


def find_runs(docs: DataFrame, words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, text, runs) of every row; ``text`` is what is left of it when every run keeps
    its first period only, words joined by one space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.list_(_RUN))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(words, times, 1, schema), f"doc_id long, text string, runs {RUNS_DDL}")


def collapse(docs: DataFrame, words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """The documents, all columns kept; a text with runs keeps the first period of each.

    ``n_chars``, if there is such a column, is set anew where the text changed. Texts without
    runs pass unchanged.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    names = docs.columns
    row = F.struct(*[F.col(f"`{n}`").alias(f"c{k}") for k, n in enumerate(names)]).alias("__row")
    rows = docs.select(row, F.col("text").cast("string").alias("__text"))
    kind = rows.schema["__row"].dataType
    schema = pa.schema([("__row", to_arrow_type(kind)), ("__text", pa.string()), ("__runs", pa.list_(_RUN))])
    ddl = f"__row {kind.simpleString()}, __text string, __runs {RUNS_DDL}"
    done = rows.mapInArrow(_scan(words, times, 1, schema), ddl)
    found = F.size("__runs") > 0
    columns = []
    for k, n in enumerate(names):
        old = F.col("__row")[f"c{k}"]
        if n == "text":
            old = F.when(found, F.col("__text")).otherwise(old)
        elif n == "n_chars":
            old = F.when(found, F.char_length("__text").cast(docs.schema[n].dataType)).otherwise(old)
        columns.append(old.alias(n))
    return done.select(*columns)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents, by a checksum of the id, end periodically.

    With h the CRC-32 of the decimal id and g = h div 10, a text of n words with h divisible
    by 10 repeats from word g mod n on, with period 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    step = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    step = step.select(
        "*",
        F.when(chosen, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("__words"),
        F.floor(h / 10).cast("long").alias("__g"),
    )
    n = F.size("__words")
    step = step.select("*", F.when(n > 0, F.pmod("__g", n)).cast("int").alias("__a"))
    period = 1 + F.floor((n - F.col("__a")) / (3 + F.pmod("__g", F.lit(8))))
    step = step.select("*", period.cast("int").alias("__p"))
    a, p, words = F.col("__a"), F.col("__p"), F.col("__words")
    turned = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + (i - a) % p)))
    return step.select("doc_id", F.when(n > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per document: its number of runs, its strongest run, checksums of all."""
    runs = F.col("runs")
    kind = "struct<start:long,length:long,period:long>"

    def stronger(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best["period"].isNull() | more, r).otherwise(best)

    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    step = found.select("*", F.aggregate(runs, F.lit(None).cast(kind), stronger).alias("__best"))
    best = F.col("__best")
    return step.select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
