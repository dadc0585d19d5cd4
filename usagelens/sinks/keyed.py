"""A table with one row per key, kept up to date by replace-by-key.

Plain Parquet has no MERGE. The rows are spread over a fixed number of hash shards; a
refresh rewrites only the shards its keys fall into and leaves the others where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.operators.maintenance import conform, latest_per_key
from usagelens.sinks import versions
from usagelens.sources.snapshots import ARRIVAL

SHARD = "shard"
SEQUENCE = "ingest_seq"

_COMMIT = f"{SHARD} int, shards int, data_version int"


@dataclass(frozen=True)
class KeyedTable:
    """``shards`` is fixed for the life of the table; size it so that a shard is a few files."""

    root: str
    schema: T.StructType
    keys: tuple[str, ...]
    carry: tuple[str, ...] = ()
    shards: int = 64
    fill_nulls: tuple[str, ...] = ()

    def _shard(self) -> Column:
        # by the first key only: the shard count bounds folders, not parallelism
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.shards)).cast("int").alias(SHARD)

    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(SEQUENCE, T.LongType())])

    def _places(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        """Shard -> version that holds its rows, by the newest commit. At most one row per
        shard comes to the driver.
        """
        newest = versions.latest_version(spark, self.root, before)
        if newest is None:
            return {}
        rows = versions.read_commit(spark, self.root, newest, _COMMIT).collect()
        if any(row["shards"] != self.shards for row in rows):
            raise ValueError(f"{self.root} was created with another number of shards")
        return {row[SHARD]: row["data_version"] for row in rows}

    def _rows(self, spark: SparkSession, places: dict[int, int]) -> DataFrame:
        if not places:
            return spark.createDataFrame([], self._stored())
        paths = [f"{versions.data_path(self.root, v)}/{SHARD}={s}" for s, v in places.items()]
        # the schema is given, so no footers are read; older files may lack some columns
        rows = spark.read.schema(self._stored()).parquet(*paths)
        return conform(rows, self._stored(), self.fill_nulls)

    def read(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        """The rows by the newest commit, or by the newest one up to a version."""
        before = None if upto is None else upto + 1
        return self._rows(spark, self._places(spark, before)).select(*self.schema.names)

    def shards_of(self, updates: DataFrame) -> set[int]:
        """Numbers of the shards the rows fall into; at most as many as there are shards."""
        return {row[SHARD] for row in updates.select(self._shard()).distinct().collect()}

    def upsert(
        self,
        spark: SparkSession,
        updates: DataFrame,
        version: int,
        touched: set[int] | None = None,
    ) -> None:
        """Merge ``updates`` (columns of the schema, optionally ``arrival``) as ``version``.

        Newer ``collected_at`` wins, at equal times the later version. Repeating a version
        starts from the versions before it, so it changes nothing. ``touched`` are the shards
        of the rows where the caller knows them.
        """
        touched = self.shards_of(updates) if touched is None else touched
        if not touched:
            return
        keys = list(self.keys)
        order = ["collected_at", *([ARRIVAL] if ARRIVAL in updates.columns else [])]
        # several rows of one key are reduced first, before they meet in one shard
        fresh = latest_per_key(updates, keys, order, list(self.carry))
        fresh = conform(fresh, self.schema).withColumn(SEQUENCE, F.lit(version).cast("bigint"))
        places = self._places(spark, before=version)
        old = {shard: v for shard, v in places.items() if shard in touched}
        both = self._rows(spark, old).unionByName(fresh) if old else fresh
        both = both.withColumn(SHARD, self._shard())
        # one shuffle serves the merge and the file layout: grouping by (shard, key) accepts
        # rows that are already together by shard
        merged = latest_per_key(
            both.repartition(SHARD), [SHARD, *keys], ["collected_at", SEQUENCE], list(self.carry)
        )
        target = versions.data_path(self.root, version)
        merged.write.mode("overwrite").options(**versions.NAME_FILTER).partitionBy(SHARD).parquet(target)
        # each commit is a whole map, so a reader needs only the newest one; a shard without
        # rows has no folder
        places |= dict.fromkeys(versions.numbered(spark, target, SHARD), version)
        entries = [(shard, self.shards, v) for shard, v in sorted(places.items())]
        versions.commit(spark.createDataFrame(entries, _COMMIT), self.root, version)

    def drop_old(self, spark: SparkSession, keep: int = 10) -> None:
        """Remove commits before the newest ``keep``, and shards none of the rest needs."""
        found = versions.committed(spark, self.root)
        needed = {place for v in found[-keep:] for place in self._places(spark, v + 1).items()}
        for version in found[:-keep]:
            versions.remove(spark, versions.commit_path(self.root, version))
        # a version after the newest commit may be a run in progress
        for version in found:
            folder = versions.data_path(self.root, version)
            for shard in versions.numbered(spark, folder, SHARD):
                if (shard, version) not in needed:
                    versions.remove(spark, f"{folder}/{SHARD}={shard}")
