"""Helpers shared by the operators: written intermediates and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(rows: DataFrame, purpose: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """The rows, written below ``spark.checkpoint.dir`` and read again, and their folder.

    It cuts the lineage: what is lost with an executor is read again from the shared folder.
    """
    path = work_dir(rows.sparkSession, f"llm-{purpose}")
    rows.write.option("compression", compression).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written intermediate that no later plan reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(path: str, columns: list[str]) -> pa.Table:
    """A Parquet folder of the shared storage, read by a task's Python itself."""
    from pyarrow import dataset, fs  # large libraries, which other tasks do without

    scheme, found, rest = path.partition("://")
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    place = f"{scheme}://{rest}" if found else path.removeprefix("file:")
    system, inner = fs.FileSystem.from_uri(place)
    return dataset.dataset(inner, filesystem=system, format="parquet").to_table(columns)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a few flat column types, as ``mapInArrow`` returns them."""
    types = {
        "long": pa.int64(),
        "int": pa.int32(),
        "string": pa.string(),
        "binary": pa.binary(),
        "boolean": pa.bool_(),
        "double": pa.float64(),
    }
    return pa.schema([(n, types[t]) for n, t in (column.split() for column in ddl.split(", "))])


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows at most."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def in_parts(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that what Python makes of their texts stays small."""
    for batch in batches:
        yield from pieces(batch, rows)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``; after it Arrow returns the memory that it holds unused.

    A worker stays for other tasks and waits beside those at work.
    """

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) of every node of the undirected edges (a long, b long).

    Alternates the large-star and the small-star step until no edge changes: each node's
    neighbours move to its smallest neighbour. Roots are the smallest node of their component.
    Each step is a grouped minimum (pre-aggregated) and a join with it; the minimum is written
    first, so that the adaptive plan can split the neighbours of a hub. Nulls and loops are
    left out; no edges give no rows. The driver gets one count and one checksum a round.
    """
    spark = edges.sparkSession

    def star(links: DataFrame, large: bool) -> DataFrame:
        if large:
            near = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low, path = written(
            near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")),
            f"{purpose}-min",
        )
        moved = near.join(low, "a")
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                low.select("a", F.col("m").alias("b"))
            )
        out, kept = written(moved.where("a <> b").distinct(), purpose)
        discard(spark, path)
        return out, kept

    def state(links: DataFrame) -> tuple:
        mark = F.xxhash64("a", "b").cast("decimal(38,0)")
        return tuple(links.agg(F.count("*"), F.sum(mark)).first())

    now, path = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b")
        .distinct(),
        purpose,
    )
    seen = state(now)
    while seen[0]:
        big, big_path = star(now, large=True)
        small, small_path = star(big, large=False)
        discard(spark, path)
        discard(spark, big_path)
        now, path = small, small_path
        after = state(now)
        if after == seen:
            break
        seen = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
