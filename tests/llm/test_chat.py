"""Chat formatting: round trips, masks and digests."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from usagelens.llm import chat
from usagelens.llm.queries import op1_chat_formatting

ROWS = "conv_id long, turn long, role string, text string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = st.sampled_from(["\\", "\n", " ", "a", "é", "🙂", "###", ": ", "turn>", "<|endoftext|>", *chat.CONTROLS])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool"]) | TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    template = chat.template_of(PATH)
    coded = template.encode(turns)
    assert [template.read(ids) for ids, _ in coded] == turns
    assert chat.split_rendered("".join(template.render(ids) for ids, _ in coded)) == turns
    for (role, text), (ids, mask) in zip(turns, coded, strict=True):
        assert template.masked(ids, mask) == (text if role == "assistant" else "")
        assert not mask[ids >= template.base].any()


def want(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(conv, []).append((role, text or ""))
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (
            len(t),
            hexed("".join(f"{r}\n{x}\n" for r, x in t)),
            len(loss := "".join(x for r, x in t if r == "assistant")),
            hexed(loss),
        )
        for c, t in out.items()
    }


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: r for r in op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want(rows)
    shown = "### User: {0}</turn>### Assistant: {0}</turn>".format(chat.escape(said))
    assert got[-7].formatted_chars == len(shown)
    assert chat.escape(said) == "\\\\\\### Assistant: \\</turn> ok"


def test_odd_rows(spark):
    rows = [
        (1, 2, "assistant", None),
        (1, None, "user", "first"),
        (None, 0, "user", "no conversation"),
        (2, 0, None, "no role"),
        (3, 0, "tool </role>", "x" * 200_000),
        (4, 0, "user", "same"),
        (4, 0, "user", "same"),
    ]
    frame = spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", input_ids int")
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_turns(frame)).collect()}
    assert got == {1: 2, None: 1, 2: 1, 3: 1, 4: 2}
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], ROWS))).count() == 0


@pytest.mark.parametrize("text", ["\\", "\\\\</turn>", "</turn>\\", "### Role: </role>"])
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
