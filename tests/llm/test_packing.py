"""Packing: ids against whole-text encoding, gapless pieces, the curve, odd rows."""

from __future__ import annotations

import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from usagelens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True


def whole_ids(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts):
    """rows: pieces with ids; texts: (doc_id, text)."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) // 2 > 0
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in texts:
        ids, pieces = whole_ids(text), got[doc]
        copies = sum(1 for p in pieces if p.start == 0)
        assert copies == sum(1 for d, _ in texts if d == doc)
        assert {p.doc_tokens for p in pieces} == {len(ids)}
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert packing.decoded(p.ids).tolist() == ids[p.start : p.start + p.length]
    assert set(got) == {d for d, _ in texts}


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_digests(spark):
    docs = spark.createDataFrame([(1, "a few words " * 700)], "doc_id long, text string")
    rows = packing.piece_digests(packing.pack(docs)).collect()
    ids = whole_ids("a few words " * 700)
    assert sum(r.length for r in rows) == len(ids) > 1024
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_odd_rows(spark):
    texts = [
        (None, None),
        (1, ""),
        (2, " "),
        (3, "  two  spaces \n\n new\tline end "),
        (4, "nul \0 inside and <|endoftext|> marks"),
        (5, "Unicode\u00a0space \u2003 日本語 🙂 naïve"),
        (6, "same"),
        (6, "same"),
        (7, "long " * 5000),
        (8, " lead and 12 3's don't"),
    ]
    docs = spark.createDataFrame([(d, t, b"x") for d, t in texts], "doc_id long, text string, ids binary")
    check(packing.pack(docs).collect(), texts)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.piece_digests(packing.pack(none)).count() == 0


def test_curve_visits_neighbours():
    cells = np.array(list(product(range(8), repeat=3)))
    keys = packing.hilbert_key(cells, bits=3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_copies_are_neighbours(spark):
    rows = [(i, f"word{i % 50} other{i % 50} thing{i % 50}") for i in range(500)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    places = {}
    for r in packed:
        places.setdefault(r.doc_id % 50, set()).add(r.curve)
    assert all(len(p) == 1 for p in places.values())
    assert len(set.union(*places.values())) > 25


def test_parts_of_words():
    texts = [
        "a.b", "don't stop's, it's", "'s", " x", "", "\n", "a\nb", "a \nb", "$$$ ab$$ 's'", "é!! É.", "ß's,",
        "a\0b", "日本 語。", "x y", "naïve,naïve", "ŉa ǅ Ω", "a_b_ _", "a''s", "12ab, ab12.", "🙂🙂 a🙂", None,
    ]
    got = packing.WordTokens(PATH).encode(pa.array(texts))
    assert [g.tolist() for g in got] == [whole_ids(t)[:-1] for t in texts]
    assert packing.WordTokens(PATH).encode(pa.array([], pa.string())) == []


def test_batches_by_size():
    texts = ["a" * 10, None, "b" * 35, "", "c" * 5, "d" * 6]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    parts = [p.column(0).to_pylist() for p in packing.by_size([batch, batch.slice(0, 0)], 20)]
    assert sum(parts, []) == texts and len(parts) > 1
