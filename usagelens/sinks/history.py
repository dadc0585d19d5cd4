"""Append-only history, partitioned by day."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.times import PARTITION_DATE
from usagelens.schemas import HISTORY
from usagelens.sinks.versions import NAME_FILTER

_LAYOUT = T.StructType(
    [
        *HISTORY.fields,
        T.StructField(PARTITION_DATE, T.DateType()),
        T.StructField("version", T.IntegerType()),
    ]
)


def version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


def with_date(history: DataFrame) -> DataFrame:
    return history.withColumn(PARTITION_DATE, F.col("collected_at").cast("date"))


def append_history(history: DataFrame, path: str, version: int) -> None:
    """Add rows as ``version``. A version is one folder and is replaced as a whole, so
    writing it again, also with other rows, leaves nothing behind.
    """
    (
        # a day is spread over as many files as its size needs, small days share a task;
        # sorted by name, a file's statistics let lookups of one entity skip row groups
        with_date(history)
        .hint("rebalance", PARTITION_DATE)
        .sortWithinPartitions(PARTITION_DATE, "bucket_name")
        .write.mode("overwrite")
        .options(**NAME_FILTER)
        .partitionBy(PARTITION_DATE)
        .parquet(version_path(path, version))
    )


def read_history(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The history with its partition date; time filters go through ``times.since``.

    ``upto`` is the newest complete version: rows of a run that is not finished stay unseen.
    """
    try:
        rows = spark.read.schema(_LAYOUT).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _LAYOUT)
    if upto is not None:
        rows = rows.filter(F.col("version") <= upto)
    return rows.drop("version")


def compact_history(spark: SparkSession, path: str, target: str, upto: int) -> None:
    """Rewrite a history of many small appends as few files per day, in a new folder.

    ``upto`` is the newest complete version; rows of a run that is not finished are left out.
    """
    append_history(read_history(spark, path, upto), target, 0)
