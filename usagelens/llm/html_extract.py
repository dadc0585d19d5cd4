"""Main text of web pages: a recurrent labeller reads all blocks of a page and names their roles.

The blocks of a page (``html_blocks``) go as one sequence through a bidirectional LSTM
(``html_model``) that sees tag paths, hashed words and measures of each, so a block is judged
by the whole document around it. It is trained here on sampled pages (``html_samples``), a
bounded number by parameter, the same on every machine. Tasks work on some MB of pages at a
time; a longer page is worked on alone, whatever its length, as one sequence.

Character references are decoded, white space in a block (no-break spaces, too) becomes one
space, blocks of the article are joined by two line ends.

Defined cases: a null or empty page, and one without an article, has an empty text; a page
without markup is one block; repeated rows and ids give one row each; null ids and urls are
kept; two roles that are as likely: the one named first; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.llm.common import arrow_schema
from usagelens.llm.html_blocks import Block, blocks
from usagelens.llm.html_model import PAGES, ROLES, Labeller, trained

BETWEEN = "\n\n"
#: Characters of pages that are worked on together.
PART = 2_000_000


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """Ids, urls and pages of some MB together."""
    ids: list = []
    urls: list = []
    pages: list = []
    size = 0
    for batch in batches:
        for k in range(batch.num_rows):
            page = batch.column(2)[k].as_py() or ""
            if pages and size + len(page) > PART:
                yield ids, urls, pages
                ids, urls, pages, size = [], [], [], 0
            ids.append(batch.column(0)[k].as_py())
            urls.append(batch.column(1)[k].as_py())
            pages.append(page)
            size += len(page)
    if pages:
        yield ids, urls, pages


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )


def main_text(found: list[Block], roles: np.ndarray) -> str:
    return BETWEEN.join(b.text for b, r in zip(found, roles.argmax(axis=1), strict=True) if r == 0)


def extract(pages: DataFrame, labeller: Labeller | None = None, sampled: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page."""
    labeller = labeller or trained(sampled)
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, own in _parts(batches):
            found = [blocks(p) for p in own]
            texts = [main_text(b, r) for b, r in zip(found, labeller.label(found), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                schema=schema,
            )

    return _source(pages).mapInArrow(run, ddl)


def label_blocks(pages: DataFrame, labeller: Labeller | None = None, sampled: int = PAGES) -> DataFrame:
    """(page_id, url, block, role, probability, text): every block of every page, numbered from 0."""
    labeller = labeller or trained(sampled)
    ddl = "page_id long, url string, block long, role string, probability double, text string"
    schema = arrow_schema(ddl)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, own in _parts(batches):
            found = [blocks(p) for p in own]
            for i, (b, roles) in enumerate(zip(found, labeller.label(found), strict=True)):
                n = len(b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i]] * n, pa.int64()),
                        pa.array([urls[i]] * n, pa.string()),
                        pa.array(range(n), pa.int64()),
                        pa.array([ROLES[r] for r in roles.argmax(axis=1)], pa.string()),
                        pa.array(roles.max(axis=1, initial=0).astype(np.float64)),
                        pa.array([x.text for x in b], pa.string()),
                    ],
                    schema=schema,
                )

    return _source(pages).mapInArrow(run, ddl)
