"""Landed files -> tables and serving snapshot, one run per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from usagelens.plans.duty import publish_duty
from usagelens.plans.refresh import StatsStore, load_documents
from usagelens.plans.serving import publish_serving
from usagelens.sources.borders import items_of, raw_parts
from usagelens.sources.snapshots import ARRIVAL, BLOCK, BROKEN, array_documents, stream_lines
from usagelens.sources.sync import sync_resolved

# Fixed value: seconds between refreshes.
REFRESH_SECONDS = 300


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def _started(
    rows: DataFrame,
    load: Callable[[DataFrame, int, tuple[str, int]], None],
    store: StatsStore,
    checkpoint: str,
    serving_root: str | None = None,
    as_of: datetime | None = None,
    once: bool = False,
    refresh_seconds: int = REFRESH_SECONDS,
    keep: int = 10,
    duty_root: str | None = None,
    inventory: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Start a query whose micro-batches ``load`` applies as versions of the store."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = stream_id(spark, checkpoint)
        if store.last_batch(spark, stream) < batch_id:
            load(batch, store.next_version(spark), (stream, batch_id))
        now = as_of or datetime.now(timezone.utc).replace(tzinfo=None)
        newest = store.last_version(spark)
        if serving_root:
            cur = store.tables(spark).cur
            publish_serving(cur, serving_root, newest, now, table=store.current, table_version=newest)
        if duty_root and inventory:
            publish_duty(inventory(), store.tables(spark).cur, duty_root, newest, now)
        store.drop_old(spark, keep)

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{refresh_seconds} seconds").start()


def refresh_stream(documents: DataFrame, store: StatsStore, checkpoint: str, *args: object, **options: object) -> StreamingQuery:
    """Start the refresh of a document stream (``value``, ``collected_at``, ``arrival``).

    Every micro-batch becomes the next version of the tables. The commit of a version records
    the batch, under the id of the query, which its checkpoint keeps: a batch replayed after its
    commit is not applied again, one replayed before it replaces its own half-written version,
    and a new checkpoint, also at an old place, is another stream. With ``once``
    the stream drains what has landed and stops. ``serving_root`` is where the snapshot is
    published; ``as_of`` fixes its time, by default it is the time of the batch. The newest ``keep``
    versions stay. ``duty_root`` is where the work list and the plan are published for the
    collector, against the ``inventory`` as it is then.
    """

    def load(batch: DataFrame, version: int, mark: tuple[str, int]) -> None:
        load_documents(batch.sparkSession, store, batch, version, mode="stream", batch=mark)

    return _started(documents, load, store, checkpoint, *args, **options)


_LINE, _LIST, _SYNC = "line", "list", "sync"
_FETCH = "bucket string, ok boolean, stdout string, stderr string"


def feeds(
    spark: SparkSession,
    lines: str | None = None,
    arrays: str | None = None,
    sync: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """One stream over folders of several kinds: documents a line, list files (the admin tool's
    own output, read in parts), and replication status fetches, one JSON object a line with
    ``bucket, ok, stdout, stderr``.
    """
    found = []
    for kind, path, end in ((_LINE, lines, "\n"), (_LIST, arrays, ","), (_SYNC, sync, "\n")):
        if path:
            reader = spark.readStream.option("lineSep", end)
            if files_per_trigger:
                reader = reader.option("maxFilesPerTrigger", files_per_trigger)
            found.append(raw_parts(reader.text(path)).withColumn("kind", F.lit(kind)))
    if not found:
        raise ValueError("no folder given")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows


def _documents(batch: DataFrame) -> DataFrame:
    """Documents of a batch: ``value, collected_at, arrival, broken``."""
    lines = batch.filter((F.col("kind") == _LINE) & (F.trim("text") != ""))
    # within a block the ids rise from line to line
    place = F.struct("block", F.monotonically_increasing_id().alias("line"))
    lines = lines.select(F.col("text").alias("value"), "collected_at", place.alias(ARRIVAL), F.lit(False).alias(BROKEN))
    items = array_documents(items_of(batch.filter(F.col("kind") == _LIST).drop("kind")))
    place = F.struct(F.lit(0).cast("bigint").alias(BLOCK), F.col(ARRIVAL).cast("bigint").alias("line"))
    return lines.unionByName(items.withColumn(ARRIVAL, place))


def _readings(batch: DataFrame) -> DataFrame:
    """Replication status of a batch; lines without an entity name say nothing."""
    place = F.struct("block", F.monotonically_increasing_id().alias("line"))
    lines = batch.filter(F.col("kind") == _SYNC).select(
        "collected_at", place.alias(ARRIVAL), F.from_json("text", _FETCH).alias("fetch")
    )
    fetched = lines.select("collected_at", ARRIVAL, "fetch.*").withColumnRenamed("bucket", "bucket_name")
    fetched = fetched.filter(F.coalesce("bucket_name", F.lit("")) != "").withColumn("ok", F.coalesce("ok", F.lit(False)))
    return sync_resolved(fetched)


def refresh_feeds(rows: DataFrame, store: StatsStore, checkpoint: str, *args: object, **options: object) -> StreamingQuery:
    """Start the refresh of ``feeds``: documents and replication status in one query.

    The latest status of each entity is kept with the tables, under the same commit, so it
    survives a restart. It goes to the entity's row whichever of the two lands first. Options as for
    ``refresh_stream``.
    """

    def load(batch: DataFrame, version: int, mark: tuple[str, int]) -> None:
        load_documents(
            batch.sparkSession, store, _documents(batch), version, "stream", batch=mark, readings=_readings(batch)
        )

    return _started(rows, load, store, checkpoint, *args, **options)


def refresh_folder(
    spark: SparkSession,
    landing: str,
    store: StatsStore,
    checkpoint: str,
    files_per_trigger: int | None = None,
    **options: object,
) -> StreamingQuery:
    """The refresh of a folder in which files with one document per line land."""
    return refresh_stream(
        stream_lines(spark, landing, files_per_trigger), store, checkpoint, **options
    )
