from __future__ import annotations

import pathlib
import sys
from datetime import datetime

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from usagelens.operators.maintenance import conform  # noqa: E402
from usagelens.schemas import CURRENT, HISTORY  # noqa: E402
from usagelens.session import local_session  # noqa: E402

NOW = datetime(2024, 5, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = local_session(cores="8", **{"spark.checkpoint.dir": str(shared)})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_cur(spark):
    """Current rows from dicts; columns left out get their typed default."""

    def make(*rows: dict):
        given = [f for f in CURRENT.fields if any(f.name in r for r in rows)]
        values = [tuple(r.get(f.name) for f in given) for r in rows]
        schema = type(CURRENT)(given or [CURRENT["bucket_name"], CURRENT["collected_at"]])
        return conform(spark.createDataFrame(values, schema), CURRENT)

    return make


@pytest.fixture
def make_hist(spark):
    """History from ``(name, time, size, objects[, shards])``."""

    def make(*rows: tuple):
        full = [
            (i, name, size, objects, rest[0] if rest else 0, 0, ts)
            for i, (name, ts, size, objects, *rest) in enumerate(rows)
        ]
        return spark.createDataFrame(full, HISTORY)

    return make


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]
