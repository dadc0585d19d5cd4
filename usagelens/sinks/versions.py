"""Versioned Parquet folders.

A version is written to its own folder and becomes visible by a commit folder written
after it. Writing a version again replaces it, so a job that died half way, or a replayed
micro-batch, is simply repeated. Readers only ever see folders that no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Parquet keeps a Bloom filter of the names of each row group, as large as they need: a look-up
#: of one entity reads the groups that may hold it. Names are hashed over files and row groups, so
#: least and greatest values alone would not tell.
NAME_FILTER = {
    "parquet.bloom.filter.enabled#bucket_name": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.fpp#bucket_name": "0.001",
}


def data_path(root: str, version: int) -> str:
    return f"{root}/data/version={version}"


def commit_path(root: str, version: int) -> str:
    return f"{root}/commits/version={version}"


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path itself, whatever storage it is on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix=<n>`` in a folder."""
    files, folder = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(n.removeprefix(f"{prefix}=")) for n in names if n.startswith(f"{prefix}="))


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def commit(rows: DataFrame, root: str, version: int) -> None:
    """Make a version visible. ``rows`` describes it and is small."""
    rows.coalesce(1).write.mode("overwrite").parquet(commit_path(root, version))


def _complete(spark: SparkSession, root: str, version: int) -> bool:
    files, mark = _folder(spark, f"{commit_path(root, version)}/_SUCCESS")
    return files.exists(mark)


def committed(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first. Only folder names are looked at."""
    found = numbered(spark, f"{root}/commits", "version")
    return [v for v in found if _complete(spark, root, v)]


def latest_version(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest complete version, found with one listing and usually one more look."""
    for version in reversed(numbered(spark, f"{root}/commits", "version")):
        if (before is None or version < before) and _complete(spark, root, version):
            return version
    return None


def read_commit(spark: SparkSession, root: str, version: int, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(commit_path(root, version))


def drop_old(spark: SparkSession, root: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions of folders that stand for themselves."""
    for version in committed(spark, root)[:-keep]:
        remove(spark, commit_path(root, version))
        remove(spark, data_path(root, version))
