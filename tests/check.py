"""Compare registered queries with their SQL: ``python tests/check.py [sf_dir] [key...]``."""

from __future__ import annotations

import datetime
import decimal
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return value


# Spark type name -> DuckDB type name
_TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def differences(frame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and its SQL: names, types, rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = dict(zip(names, [str(d[1]) for d in result.description], strict=True))
    expected = result.fetchall()
    problems = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    for name, dtype in frame.dtypes:
        if _TYPES.get(dtype, dtype) != types[name]:
            problems.append(f"type of {name}: {dtype} != {types[name]}")
    order = sorted(names)
    at = [names.index(n) for n in order]

    def key(row: tuple) -> tuple:
        return tuple((v is None, str(v)) for v in row)

    want = sorted([tuple(_plain(r[i]) for i in at) for r in expected], key=key)
    got = sorted([tuple(_plain(r[n]) for n in order) for r in frame.collect()], key=key)
    if len(want) != len(got):
        problems.append(f"{len(got)} rows, expected {len(want)}")
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        fields = [n for n, g, w in zip(order, *wrong[0]) if g != w]
        problems.append(f"{len(wrong)} rows differ, first in {fields}: {wrong[0]}")
    return problems or ([] if want else ["no rows"])


def main() -> None:
    import __spark_entry__ as entry
    from usagelens.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in sys.argv[2:] or queries:
        start = time.time()
        try:
            frame = queries[key](spark, sf_dir)
            problems = differences(frame, con, sql[key]) if key in sql else ["no SQL"]
        except Exception as error:  # report and go on with the other keys
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {key} {time.time() - start:.2f}s", *problems, sep="\n    ")
    print(f"{bad} of {len(sys.argv[2:] or queries)} differ; keys without SQL: {sorted(set(queries) - set(sql))}")


if __name__ == "__main__":
    main()
