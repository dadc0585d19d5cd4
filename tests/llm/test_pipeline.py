"""The pipeline stage by stage against plain functions over the rows each stage got."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as pipeline
import pyarrow as pa
from test_decontam import slow_scan
from test_packing import check as check_pieces
from test_secret_scan import slow_base, slow_entropy
from test_simhash import slow_components, slow_fingerprint

from usagelens.llm import packing, quality
from usagelens.llm.common import table, written

ROOT = Path(__file__).resolve().parents[2]
SF = "/root/testdata/sf0.001"


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out, _ = written(stage(spark, seen[-1], SF), "test-stage")
        if name != "packing":
            assert out.columns == columns and out.dtypes == docs.dtypes
        seen.append(out)
    start, good, single, clean, safe = [rows_of(s) for s in seen[:5]]

    kept = {r.doc_id for r in quality.classify(docs, table(spark, SF, "labels")).collect() if r.kept}
    assert good == {d: r for d, r in start.items() if d in kept}
    marked = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    wrong = [d for d, q in marked.items() if d in start and (d in good) != (q == 1)]
    assert len(wrong) <= 0.05 * len(marked)

    prints = [(d, slow_fingerprint(r.text)) for d, r in good.items()]
    smallest = slow_components(prints)
    assert single == {d: r for d, r in good.items() if smallest[d] == d}

    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for d, r in single.items():
        n, hit, *_ = slow_scan(r.text, items)
        if hit > 0.5 * n:
            assert d not in clean
        elif not hit:
            assert clean[d] == r
        else:
            assert slow_scan(clean[d].text, items)[0] == n - hit and clean[d].n_chars == len(clean[d].text)
    assert set(clean) <= set(single)

    assert set(safe) == set(clean)
    for d, r in clean.items():
        base = slow_base(r.text)
        if not base and not slow_entropy(r.text, base):
            assert safe[d] == r
        else:
            assert "[secret]" in safe[d].text and not slow_base(safe[d].text)

    check_pieces(seen[5].collect(), [(d, r.text) for d, r in safe.items()])


def test_run_registers(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is pipeline.run
    assert [n for n, _ in pipeline.STAGES][-1] == "packing"


def test_stages_take_odd_rows(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "A few words. " * 9, None, None, None)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        now = docs
        for _, stage in pipeline.STAGES:
            now, _ = written(stage(spark, now, SF), "test-odd")
        if docs.isEmpty():
            assert now.count() == 0


class Run:
    """Takes a frame's place and keeps the function that workers would get."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_workers_return_memory(spark):
    run = packing.tokenized(Run(), packing.public_tokenizers.path(packing.TOKENIZER))
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}, {rng.random()}" for _ in range(100)) for _ in range(2500)]
    pool, batch = pa.default_memory_pool(), pa.RecordBatch.from_pydict({"doc_id": range(2500), "text": texts})

    def held():
        found = re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())
        return int(found[1]) / 1024

    pool.release_unused()
    assert sum(b.num_rows for b in run([batch])) == 2500
    after = held()
    pool.release_unused()
    assert after - held() < 10  # MB; Arrow kept several times the batch


def test_workers_do_without_pandas():
    code = "import sys, usagelens.llm.quality, usagelens.llm.simhash, usagelens.llm.packing; print('pandas' in sys.modules)"
    got = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert got.stdout.strip() == "False"
