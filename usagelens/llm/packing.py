"""Packing along a space-filling curve.

Token ids of each document are hashed into a few dimensions, its place on a Hilbert curve
through them becomes a sort key, and neighbouring documents are cut one after the other into
sequences of at most ``length`` tokens.

Defined cases: a null or empty text is only the closing id; repeated rows and ids are packed
each for itself; documents at one point of the curve (copies) are ordered by ``doc_id``, so a
large group of them is dealt over many tasks; a null ``doc_id`` sorts first; a text of any length
is encoded whole, in its task's memory, and cut into as many sequences as it needs; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from usagelens.llm.common import arrow_schema, in_parts, lean, written

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END = 0
DIMENSIONS, BITS = 3, 16
# Bytes of text encoded together.
_TOGETHER = 8 << 20


def _shown() -> np.ndarray:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    for itself, U+0100 and what follows for the other bytes in their order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    out = np.arange(256, dtype="<u4")
    out[others] = 256 + np.arange(len(others))
    return out


_SHOWN = _shown()
# White space that is not one blank or line end between two other characters, and NUL.
_LOOSE = (
    r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Letters that every version of Unicode calls so, and the ASCII punctuation of which a run after
# a letter begins a token of the pre-tokeniser (an apostrophe may belong to the word).
_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
_STOP = "[" + re.escape(string.punctuation.replace("'", "")) + "]"


class WordTokens:
    """Ids of whole texts by a ``tokenizers`` file, each distinct word of a call encoded once.

    The pre-tokeniser never joins across a single space between two other characters but puts
    it before the next word, a single line end is a token by itself, and a word ends before a
    stop. So the ids of a text are those of its parts between these places, and the parts of
    texts come again and again. Texts with other white space are encoded whole. No special
    token is recognised in a text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        if self._tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        # the merges alone, for words in the characters of the vocabulary between line ends
        line = chr(_SHOWN[10])
        self._words = Tokenizer(self._tokenizer.model)
        self._words.pre_tokenizer = Split(line, "isolated")
        self._line = self._tokenizer.token_to_id(line)

    @staticmethod
    def _each(tokenizer: Tokenizer, texts: Iterable[str]) -> list[np.ndarray]:
        """One after the other: what the library keeps of a text besides its ids is large."""
        encode = tokenizer.encode_batch_fast
        return [np.array(encode([text], add_special_tokens=False)[0].ids, "<u2") for text in texts]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return self._each(self._tokenizer, texts)

    def _by_merges(self, words: list[str]) -> list[np.ndarray]:
        """The ids of words that are each one token of the pre-tokeniser, a line end after each."""
        joined = ("\n".join(words[k : k + 512]) + "\n" for k in range(0, len(words), 512))
        shown = (_SHOWN[np.frombuffer(j.encode(), np.uint8)].tobytes().decode("utf-32-le") for j in joined)
        return self._each(self._words, shown)

    def _tidy(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of texts without loose white space."""
        marked = pc.replace_substring_regex(texts, f"({_LETTER})({_STOP})", "\\1\0\\2")
        marked = pc.replace_substring(pc.replace_substring(marked, "\n", "\0\n\0"), " ", "\0 ")
        split = pc.split_pattern(marked, "\0")
        coded = split.flatten().dictionary_encode()
        parts, places = coded.dictionary, coded.indices.to_numpy()
        is_word = pc.match_substring_regex(parts, rf"\A ?{_LETTER}+\z")
        words, rest = parts.filter(is_word).to_pylist(), parts.filter(pc.invert(is_word)).to_pylist()
        # all ids of the words and where each word's line end was
        ids = np.concatenate([*self._by_merges(words), np.empty(0, "<u2")])
        ends = np.flatnonzero(ids == self._line)
        ends = ends - np.arange(len(ends))
        others = self._whole(rest)
        ids = np.concatenate([ids[ids != self._line], *others])
        more = ends[-1] if len(ends) else 0
        offsets = np.concatenate([[0], ends, more + np.cumsum([len(o) for o in others], dtype=np.int64)])
        buffers = [None, pa.py_buffer((2 * offsets).astype("<i8")), pa.py_buffer(ids)]
        codes = pa.Array.from_buffers(pa.large_binary(), len(parts), buffers)
        flags = is_word.to_numpy(zero_copy_only=False)
        order = np.empty(len(parts), np.int64)
        order[np.concatenate([np.flatnonzero(flags), np.flatnonzero(~flags)])] = np.arange(len(parts))
        _, ends, raw = codes.take(pa.array(order[places])).buffers()
        found = np.frombuffer(raw or b"", "<u2")
        at = np.frombuffer(ends, "<i8")[split.offsets.to_numpy()] // 2
        return [found[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: none) as unsigned 16-bit numbers."""
        texts = texts.fill_null("")
        loose = pc.match_substring_regex(texts, _LOOSE)
        tidy = iter(self._tidy(texts.filter(pc.invert(loose))))
        apart = iter(self._whole(texts.filter(loose).to_pylist()))
        return [next(apart if alone else tidy) for alone in loose.to_pylist()]


def by_size(batches: Iterable[pa.RecordBatch], size: int = _TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches cut to about so many bytes of their column ``text``, a longer text by itself."""
    for batch in batches:
        sizes = pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False)
        place = (np.cumsum(sizes, dtype=np.int64) - sizes) // size
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end > start:
                yield batch.slice(start, end - start)


@cache
def tokens_of(path: str) -> WordTokens:
    """One per worker and file."""
    return WordTokens(path)


@cache
def _weights(size: int, dimensions: int) -> np.ndarray:
    """A number from -128 to 127 for each id and dimension, from a multiplicative hash."""
    ids = np.arange(size, dtype=np.uint64)[:, None] * np.uint64(dimensions) + np.arange(dimensions, dtype=np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(56)).astype(np.uint8).view(np.int8)


def projected(documents: list[np.ndarray], dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The grid cell of each document: the mean weights of its ids, on 2**bits cells a dimension.

    Mean weights of texts lie near 0, so their cube roots are laid on the grid.
    """
    table = _weights(1 << 16, dimensions)
    out = np.zeros((len(documents), dimensions))
    for row, ids in enumerate(documents):
        if len(ids):
            out[row] = table[ids].sum(axis=0, dtype=np.int64) / (128 * len(ids))
    return ((np.cbrt(out) + 1) / 2 * ((1 << bits) - 1)).astype(np.int64)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position of each grid cell (rows of coordinates) on the Hilbert curve.

    Skilling's transform, on all rows at once: undo the rotations from the highest bit down,
    Gray-decode, then interleave the bits of the axes.
    """
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for k in range(n):
            on = (x[k] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[k]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if k:
                x[k] ^= swap
        q >>= 1
    for k in range(1, n):
        x[k] ^= x[k - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((x[k] ^ t) >> bit) & 1)
    return key


def tokenized(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, curve, ids): unsigned 16-bit ids with the closing id, and the curve position."""
    ddl = "doc_id long, curve long, ids binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens_of(tokenizer).encode
        for batch in by_size(batches):
            ids = encode(batch.column("text"))
            keys = hilbert_key(projected(ids))
            closed = [x.tobytes() + END.to_bytes(2, "little") for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys), pa.array(closed, pa.binary())], schema=schema
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ddl)


PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve long"
)


def _sequences(length: int):
    schema = arrow_schema(PIECES)

    def fill(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts the documents of a task one after the other into full sequences.

        Less than one sequence is held back; at the end it is cut into powers of two, which
        need no padding.
        """
        sequence = TaskContext.get().partitionId() << 32
        room, tail = length, []
        for batch in in_parts(batches):
            rows: list[tuple] = []
            for doc, curve, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, at = len(raw) // 2, 0
                while at < total:
                    size = min(room, total - at)
                    tail.append((doc, at, size, raw[2 * at : 2 * (at + size)], total, sequence, length - room, curve))
                    at += size
                    room -= size
                    if not room:
                        rows += tail
                        room, tail = length, []
                        sequence += 1
            if rows:
                yield _batch(rows, schema)
        if tail:
            yield _batch(_powers(tail, length - room), schema)

    return fill


def _powers(tail: list[tuple], left: int) -> list[tuple]:
    """The pieces of one unfilled sequence, cut anew into sequences of falling powers of two."""
    sequence, room, offset, out = tail[0][5], 1 << (left.bit_length() - 1), 0, []
    for doc, start, size, raw, total, _, _, curve in tail:
        at = 0
        while at < size:
            part = min(room, size - at)
            out.append((doc, start + at, part, raw[2 * at : 2 * (at + part)], total, sequence, offset, curve))
            at, room, offset, left = at + part, room - part, offset + part, left - part
            if not room and left:
                sequence, room, offset = sequence + 1, 1 << (left.bit_length() - 1), 0
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """One row per piece of a document in a sequence, ``ids`` as unsigned 16-bit numbers.

    Tokens are written once; the range sort samples and shuffles that table, not the texts.
    Each task fills its own sequences: ``sequence_id`` is its number times 2**32 plus a count.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    coded, _ = written(tokenized(docs, path), "packing-ids")
    along = coded.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return along.mapInArrow(lean(_sequences(length)), PIECES)


def piece_digests(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids (as unsigned 32-bit numbers) in place of the ids."""
    ddl = PIECES.replace("ids binary", "ids_crc32 long")
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes()) for raw in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array(sums, pa.int64()), *batch.columns[4:]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return packed.mapInArrow(lean(run), ddl)


def decoded(ids: bytes) -> np.ndarray:
    """The ids of a piece as numbers."""
    return np.frombuffer(ids, "<u2").astype(np.int64)
