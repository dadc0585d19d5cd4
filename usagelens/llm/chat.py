"""Chat formatting at token level.

Each turn is assembled from segments that are encoded separately: reserved ids beyond the
vocabulary stand for the template's control strings, and content never yields a reserved id.
Control strings inside contents are escaped, so that the rendered text can be taken apart
again. The loss mask is a prefix sum of +1 where an assistant's text begins and -1 where it
ends.

The template, rendered: ``### User: <text></turn>``, ``### Assistant: <text></turn>``,
``### System: <text></turn>`` and, for any other role, ``### Role: <role></role><text></turn>``.
Escaping puts a backslash before each control string and each backslash of a content.

Defined cases: a null text or role is empty (a null role is the role ``''``); a null ``turn``
sorts first; turns at one place, repeated rows too, are ordered by role and the ids of their text; a
text of any length is encoded whole, in its task's memory; rows with a
null ``conv_id`` are one conversation; an empty table gives no rows; other columns are not
read. Conversations of any length stream through their task turn by turn; no task holds one
whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from usagelens.llm.common import arrow_schema, in_parts

TOKENIZER = "byte_bpe_50k.json"
# The control strings in the order of their reserved ids, from the vocabulary's size on.
CONTROLS = ["### System: ", "### User: ", "### Assistant: ", "### Role: ", "</role>", "</turn>"]
SYSTEM, USER, ASSISTANT, ROLE, END_ROLE, END = range(len(CONTROLS))
_OPENS = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROLS)]))
_UNESCAPE = re.compile(r"\\(\\|" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


class Template:
    """The template over one vocabulary file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, turns: list[tuple[str, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, loss mask) of each (role, text); all segments are encoded in one batch."""
        segments = []
        for role, text in turns:
            if role not in _OPENS:
                segments.append(escape(role))
            segments.append(escape(text))
        coded = iter(self.tokenizer.encode_batch(segments, add_special_tokens=False))
        out = []
        for role, _ in turns:
            if role in _OPENS:
                head = [self.base + _OPENS[role]]
            else:
                head = [self.base + ROLE, *next(coded).ids, self.base + END_ROLE]
            body = next(coded).ids
            ids = np.array([*head, *body, self.base + END], np.int32)
            edge = np.zeros(len(ids), np.int32)
            if role == "assistant":
                edge[len(head)] += 1
                edge[len(ids) - 1] -= 1
            out.append((ids, np.cumsum(edge).astype(bool)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def render(self, ids: np.ndarray) -> str:
        """The formatted text: contents decoded, reserved ids as their control strings."""
        return "".join(CONTROLS[code] + self.decode(part) for code, part in self._split(ids))

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """(role, text) of one turn."""
        parts = self._split(ids)
        names = {v: k for k, v in _OPENS.items()}
        if parts[0][0] == ROLE:
            return unescape(self.decode(parts[0][1])), unescape(self.decode(parts[1][1]))
        return names[parts[0][0]], unescape(self.decode(parts[0][1]))

    def masked(self, ids: np.ndarray, mask: np.ndarray) -> str:
        """The unescaped text under the mask."""
        return unescape(self.decode(ids[mask]))

    def _split(self, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each reserved id (as its number in CONTROLS) with the ids up to the next one."""
        at = np.flatnonzero(ids >= self.base)
        return [
            (int(ids[a]) - self.base, ids[a + 1 : b]) for a, b in zip(at, [*at[1:], len(ids)], strict=True)
        ]


def split_rendered(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation, by its control strings alone."""
    parts = re.split(r"(\\\\|" + "|".join(r"\\?" + re.escape(c) for c in CONTROLS) + ")", text)
    turns, role, held = [], None, ""
    for k, part in enumerate(parts):
        if k % 2 == 0 or part.startswith("\\"):
            held += part
        elif part == CONTROLS[END]:
            turns.append((role, unescape(held)))
        elif part == CONTROLS[END_ROLE]:
            role, held = unescape(held), ""
        else:
            role = {v: r for r, v in _OPENS.items()}.get(CONTROLS.index(part))
            held = ""
    return turns


@cache
def template_of(path: str) -> Template:
    """One per worker and file."""
    return Template(path)


FORMATTED = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType(), False)),
    ]
)


def format_turns(conversations: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(conv_id, turn, role, input_ids, loss_mask), one row per turn.

    A conversation's tokens are those of its turns in the order of (turn, role, input_ids).
    Turns are formatted where they are read; nothing is shuffled.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("turn", pa.int64()),
            ("role", pa.string()),
            ("input_ids", pa.list_(pa.field("element", pa.int32(), False))),
            ("loss_mask", pa.list_(pa.field("element", pa.bool_(), False))),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = template_of(path)
        for batch in in_parts(batches):
            conv, turn, role, text = batch.columns
            coded = template.encode(list(zip(role.to_pylist(), text.to_pylist(), strict=True)))
            ids = pa.array([c[0] for c in coded], schema.field("input_ids").type)
            masks = pa.array([c[1] for c in coded], schema.field("loss_mask").type)
            yield pa.RecordBatch.from_arrays([conv, turn, role, ids, masks], schema=schema)

    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).mapInArrow(run, FORMATTED)


READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, n_tokens long"
)


class _Reading:
    """What is read back from one conversation so far."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.turns = self.loss_chars = self.chars = self.tokens = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, template: Template, ids: np.ndarray, mask: np.ndarray) -> None:
        role, text = template.read(ids)
        self.all.update(f"{role}\n{text}\n".encode())
        learnt = template.masked(ids, mask)
        self.loss.update(learnt.encode())
        self.turns += 1
        self.loss_chars += len(learnt)
        self.chars += len(template.render(ids))
        self.tokens += len(ids)

    def row(self) -> tuple:
        digests = self.all.hexdigest(), self.loss.hexdigest()
        return self.conv, self.turns, digests[0], self.loss_chars, digests[1], self.chars, self.tokens


def read_back(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation, from the ids and masks alone.

    Turns are shuffled by conversation, sorted, and read one after the other. A digest over
    the turns in order is sequential, so a conversation is read by one task, in constant memory.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    schema = arrow_schema(READ)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, now = template_of(path), None
        for batch in in_parts(batches):
            done = []
            for conv, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Reading(conv)
                now.add(template, np.array(ids), np.array(mask, bool))
            if done:
                yield _rows(done, schema)
        if now:
            yield _rows([now.row()], schema)

    return (
        formatted.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "input_ids")
        .select("conv_id", "input_ids", "loss_mask")
        .mapInArrow(run, READ)
    )


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
