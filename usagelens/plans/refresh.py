"""Landed documents -> current rows, history, usage per class, and counters."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from usagelens.operators.maintenance import latest_per_key, repair_dry_run, repair_null_times
from usagelens.operators.normalize import history_rows, normalize, usage_rows
from usagelens.operators.summary import STALE_SECONDS
from usagelens.operators.worklist import BULK_THRESHOLD, refresh_plan, refresh_worklist
from usagelens.schemas import ADDED_LATER, CLASS_USAGE, CURRENT, READING, SYNC_COLUMNS
from usagelens.sinks import versions
from usagelens.sinks.history import append_history, read_history, version_path
from usagelens.sinks.keyed import KeyedTable
from usagelens.sources.snapshots import ARRIVAL, BLOCK, BROKEN, named, parse_documents, readable
from usagelens.sources.sync import attach_sync
from usagelens.sources.tables import Tables


_COUNTERS = "fetched bigint, collected bigint, errors bigint, mode string"
# Each run carries the totals up to itself, so the state needs the newest run only.
_RUN = (
    f"{_COUNTERS}, seconds double, total_collected bigint, total_errors bigint, "
    "cycles_completed bigint, batches map<string,bigint>"
)
# What a run did with every landed row: landed = collected + errors + skipped.
METRICS = (
    "version bigint, mode string, stream string, batch bigint, landed bigint, collected bigint, errors bigint, "
    "unreadable bigint, nameless bigint, skipped bigint, readings bigint, seconds double"
)


@dataclass(frozen=True)
class StatsStore:
    """Folders of the tables under one root on shared storage; one writer at a time.

    A run writes all tables under the next version number and is committed last. Until then
    the number is not taken: whoever runs next starts from the last complete run and first
    removes whatever an unfinished one has left, whichever tables it writes itself.
    """

    root: str
    shards: int = 64

    @property
    def current(self) -> KeyedTable:
        keys, carry = ("bucket_name",), tuple(SYNC_COLUMNS)
        return KeyedTable(f"{self.root}/current", CURRENT, keys, carry, self.shards, ADDED_LATER)

    @property
    def usage(self) -> KeyedTable:
        keys = ("bucket_name", "storage_class")
        return KeyedTable(f"{self.root}/usage", CLASS_USAGE, keys, (), self.shards)

    @property
    def sync(self) -> KeyedTable:
        """The latest replication status of each entity, also of those without a document yet."""
        return KeyedTable(f"{self.root}/sync", READING, ("bucket_name",), (), self.shards)

    @property
    def history_path(self) -> str:
        return f"{self.root}/history"

    @property
    def runs(self) -> str:
        return f"{self.root}/runs"

    def metrics_path(self, version: int) -> str:
        return version_path(f"{self.root}/metrics", version)

    def quarantine_path(self, version: int) -> str:
        return version_path(f"{self.root}/quarantine", version)

    def staging_path(self, version: int) -> str:
        """Parsed rows of a run in progress; on shared storage, so that lost executors cost nothing."""
        return version_path(f"{self.root}/staging", version)

    def tables(self, spark: SparkSession, inv: DataFrame | None = None) -> Tables:
        """The tables as of the last complete run."""
        last = self.last_version(spark)
        return Tables(
            cur=self.current.read(spark, last),
            hist=read_history(spark, self.history_path, last),
            usage=self.usage.read(spark, last),
            inv=inv,
            keyed=True,
        )

    def drop_old(self, spark: SparkSession, keep: int = 10) -> None:
        """Forget all but the newest ``keep`` versions; the rows of the tables stay."""
        self.current.drop_old(spark, keep)
        self.usage.drop_old(spark, keep)
        self.sync.drop_old(spark, keep)
        versions.drop_old(spark, self.runs, keep)

    def last_version(self, spark: SparkSession) -> int:
        return versions.latest_version(spark, self.runs) or 0

    def next_version(self, spark: SparkSession) -> int:
        return self.last_version(spark) + 1

    def start_run(self, spark: SparkSession, version: int) -> float:
        """Remove what a run that died has left under a version; returns when the run started.

        Nothing is removed where the version is complete: repeating it replaces its rows.
        """
        started = time.monotonic()
        if version > self.last_version(spark):
            for root in (self.current.root, self.usage.root, self.sync.root, self.runs):
                # the commit goes first: there is never one without its rows
                versions.remove(spark, versions.commit_path(root, version))
                versions.remove(spark, versions.data_path(root, version))
            versions.remove(spark, version_path(self.history_path, version))
            versions.remove(spark, self.metrics_path(version))
            versions.remove(spark, self.quarantine_path(version))
        versions.remove(spark, self.staging_path(version))
        return started

    def last_batch(self, spark: SparkSession, stream: str) -> int:
        """The last micro-batch of a stream that is in the tables, -1 for none."""
        newest = self.last_version(spark)
        if not newest:
            return -1
        run = versions.read_commit(spark, self.runs, newest, _RUN)
        return run.select(F.coalesce(F.try_element_at("batches", F.lit(stream)), F.lit(-1))).first()[0]


def _finish_run(
    spark: SparkSession,
    store: StatsStore,
    counters: DataFrame,
    version: int,
    started: float,
    batch: tuple[str, int] | None,
) -> None:
    """Commit the run with its counters and what is known up to it."""
    previous = versions.latest_version(spark, store.runs, version)
    before = None if previous is None else versions.read_commit(spark, store.runs, previous, _RUN).first()
    batches = {**(before["batches"] if before else {}), **(dict([batch]) if batch else {})}
    pairs = [F.lit(part) for pair in batches.items() for part in pair]

    def so_far(name: str) -> Column:
        return F.lit(before[name] if before else 0).cast("bigint")

    run = counters.select(
        "*",
        F.lit(time.monotonic() - started).alias("seconds"),
        (so_far("total_collected") + F.col("collected")).alias("total_collected"),
        (so_far("total_errors") + F.col("errors")).alias("total_errors"),
        (so_far("cycles_completed") + F.when(F.col("mode") == "repair", 0).otherwise(1)).alias(
            "cycles_completed"
        ),
        F.create_map(*pairs).cast("map<string,bigint>").alias("batches"),
    )
    versions.commit(run, store.runs, version)


def _run_together(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Submit independent jobs at the same time, so that one fills the gaps of another."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        for job in running:
            job.result()


def _in_order(documents: DataFrame) -> DataFrame:
    """Adds ``arrival``: of documents with the same name and time, the last in its file wins."""
    if ARRIVAL in documents.columns:
        return documents
    if BLOCK not in documents.columns:
        # nothing is known about their order: any that is the same on a retry will do
        return documents.withColumn(ARRIVAL, F.xxhash64("value"))
    # within a block the ids rise from line to line
    place = F.struct(BLOCK, F.monotonically_increasing_id().alias("line"))
    return documents.withColumn(ARRIVAL, place).drop(BLOCK)


def _spread(documents: DataFrame) -> DataFrame:
    """A landing of a few files that cannot be split would be parsed by as few tasks; its
    texts are handed round first. A landing with enough partitions is left as it is, as are
    list files, whose elements come out of a shuffle.
    """
    if BROKEN in documents.columns:
        return documents
    cores = documents.sparkSession.sparkContext.defaultParallelism
    few = documents.rdd.getNumPartitions() < cores
    return documents.repartition(cores) if few else documents


def _on_list(documents: DataFrame, names: DataFrame) -> DataFrame:
    """Documents that may name an entity of the list, before they are parsed.

    The name is taken out of the text alone, which is much cheaper than the whole parse, and
    meets the list first; for shuffled joins Spark adds a Bloom filter of the list at run time.
    Texts without a readable name, and those that spell the key twice, are for the parse.
    """
    name = F.get_json_object("value", "$.bucket")
    plain = name.isNotNull() & (F.regexp_count("value", F.lit('"bucket"')) == 1)
    marked = documents.withColumn("_name", F.when(plain, name))
    listed = names.select(F.col("bucket_name").alias("_listed")).distinct()
    kept = marked.join(listed, F.col("_name") == F.col("_listed"), "left_semi")
    return kept.unionByName(marked.filter(F.col("_name").isNull())).drop("_name")


def _with_readings(
    spark: SparkSession, store: StatsStore, records: DataFrame, readings: DataFrame, version: int
) -> tuple[DataFrame, DataFrame]:
    """Records with the latest known status of their entity, and the stored rows of entities
    that have a new status but no document in this run.
    """
    store.sync.upsert(spark, readings, version)
    known = store.sync.read(spark, version)
    names = records.select("bucket_name").distinct()
    fresh = latest_per_key(readings, ["bucket_name"], ["collected_at", ARRIVAL]).join(names, "bucket_name", "left_anti")
    stored = store.current.read(spark, version - 1).join(fresh.select("bucket_name"), "bucket_name", "left_semi")
    return attach_sync(records, known), attach_sync(stored, known)


def load_documents(
    spark: SparkSession,
    store: StatsStore,
    documents: DataFrame,
    version: int,
    mode: str = "bulk",
    as_of: datetime | None = None,
    only: DataFrame | None = None,
    sync: DataFrame | None = None,
    save_history: bool = True,
    batch: tuple[str, int] | None = None,
    readings: DataFrame | None = None,
) -> None:
    """Apply documents (``value``, optionally ``collected_at`` and ``arrival``) as ``version``.

    ``only`` restricts the run to a list of names, ``sync`` adds replication status. Rows
    without a status keep the one already stored. Each write replaces its own version, so a
    run that failed at any point is repeated as a whole. ``batch`` names the stream and the
    micro-batch the documents come from. ``readings`` (``bucket_name``, the status columns,
    ``collected_at``, ``arrival``) are kept as the latest status of their entities, whether
    these have a document in this run, an earlier or a later one.

    The documents are parsed once and staged; what happens to every landed row is counted on the way.
    """
    started = store.start_run(spark, version)
    landed, parsed_rows = Observation(), Observation()
    documents = _in_order(documents).observe(landed, F.count(F.lit(1)).alias("landed"))
    if only is not None:
        documents = _on_list(documents, only)
    parsed = parse_documents(_spread(documents))
    flags = ["named", "readable", "listed", "bad_text"]
    bad_text = F.when(~(named() & readable()), F.col("value"))
    parsed = parsed.withColumns({"named": named(), "readable": readable(), "listed": F.lit(True), "bad_text": bad_text})
    if only is not None:
        listed = only.select(F.col("bucket_name").alias("_name"), F.lit(True).alias("_on")).distinct()
        parsed = parsed.join(listed, F.col("bucket") == F.col("_name"), "left")
        parsed = parsed.withColumn("listed", F.coalesce("_on", ~F.col("named"))).drop("_name", "_on")
    good = F.col("listed") & F.col("named") & F.col("readable")
    rows = normalize(parsed, as_of, [ARRIVAL, *flags]).observe(
        parsed_rows,
        F.count_if(F.col("listed") & F.col("named")).alias("fetched"),
        F.count_if(good).alias("collected"),
        F.count_if(F.col("listed") & ~F.col("readable")).alias("unreadable"),
        F.count_if(F.col("listed") & F.col("readable") & ~F.col("named")).alias("nameless"),
    )
    staging = store.staging_path(version)
    rows.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    try:
        rows = spark.read.schema(rows.schema).parquet(staging)
        records = rows.filter(good).drop(*flags)
        if sync is not None:
            records = attach_sync(records, sync)
        changed = records
        known = 0
        if readings is not None:
            known = readings.count()
            records, others = _with_readings(spark, store, records, readings, version)
            if known:
                others = others.withColumn(ARRIVAL, F.lit(None).cast(records.schema[ARRIVAL].dataType))
                changed = records.unionByName(others)
        # both tables are sharded by the entity name
        touched = store.current.shards_of(changed)
        classes = usage_rows(records, [ARRIVAL])
        writes = [
            lambda: store.current.upsert(spark, changed, version, touched),
            lambda: store.usage.upsert(spark, classes, version, touched),
        ]
        if save_history:
            history = history_rows(records)
            writes.append(lambda: append_history(history, store.history_path, version))
        _run_together(spark, writes)
        seen = {**landed.get, **parsed_rows.get}
        if seen["unreadable"] + seen["nameless"]:
            reason = F.when(~F.col("readable"), "unreadable").otherwise("no entity name")
            bad = rows.filter(F.col("listed") & ~(F.col("named") & F.col("readable")))
            bad = bad.select(F.col("bad_text").alias("value"), "collected_at", reason.alias("reason"))
            bad.write.mode("overwrite").parquet(store.quarantine_path(version))
        _write_metrics(spark, store, version, mode, batch, seen, known, time.monotonic() - started)
        # last: a run counts once all its tables are visible
        errors = seen["fetched"] - seen["collected"]
        counters = spark.createDataFrame([(seen["fetched"], seen["collected"], errors, mode)], _COUNTERS)
        _finish_run(spark, store, counters, version, started, batch)
    finally:
        versions.remove(spark, staging)


def _write_metrics(
    spark: SparkSession,
    store: StatsStore,
    version: int,
    mode: str,
    batch: tuple[str, int] | None,
    seen: dict[str, int],
    readings: int,
    seconds: float,
) -> None:
    """One row of ``METRICS``; written again if the run is repeated."""
    errors = seen["unreadable"] + seen["nameless"]
    skipped = seen["landed"] - seen["collected"] - errors
    stream, number = batch or (None, None)
    row = (
        version, mode, stream, number, seen["landed"], seen["collected"], errors,
        seen["unreadable"], seen["nameless"], skipped, readings, seconds,
    )
    frame = spark.createDataFrame([row], METRICS).drop("version")
    frame.coalesce(1).write.mode("overwrite").parquet(store.metrics_path(version))


def run_quarantine(spark: SparkSession, store: StatsStore) -> DataFrame:
    """``value, collected_at, reason, version`` of every landed row that is no document, of all complete runs."""
    ddl = "value string, collected_at timestamp_ntz, reason string, version bigint"
    last = store.last_version(spark)
    root = f"{store.root}/quarantine"
    if not versions.numbered(spark, root, "version"):
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(root).filter(F.col("version") <= last)


def run_metrics(spark: SparkSession, store: StatsStore) -> DataFrame:
    """What became of the rows of every complete run, one row a run; runs stay when old versions go."""
    last = store.last_version(spark)
    if not last:
        return spark.createDataFrame([], METRICS)
    return spark.read.schema(METRICS).parquet(f"{store.root}/metrics").filter(F.col("version") <= last)


def run_counters(spark: SparkSession, store: StatsStore, version: int) -> DataFrame:
    """Counters of one run."""
    run = versions.read_commit(spark, store.runs, version, _RUN)
    return run.select("fetched", "collected", "errors", "mode")


def run_state(spark: SparkSession, store: StatsStore) -> DataFrame:
    """Totals over all runs, and size, duration and rate of the last one."""
    newest = versions.latest_version(spark, store.runs)
    if newest is None:
        runs = spark.createDataFrame([], _RUN)
    else:
        runs = versions.read_commit(spark, store.runs, newest, _RUN)
    rate = F.when(F.col("seconds") > 0, F.col("collected") / F.col("seconds")).otherwise(0.0)
    return runs.select(
        "total_collected",
        "total_errors",
        "cycles_completed",
        F.col("collected").alias("last_cycle_buckets"),
        F.col("seconds").alias("last_cycle_time"),
        rate.alias("collection_rate"),
    )


def bulk_refresh(
    spark: SparkSession,
    store: StatsStore,
    documents: DataFrame,
    as_of: datetime | None = None,
    sync: DataFrame | None = None,
) -> DataFrame:
    """Refresh every entity the documents name; returns the counters of the run."""
    version = store.next_version(spark)
    load_documents(spark, store, documents, version, "bulk", as_of, sync=sync)
    return run_counters(spark, store, version)


def incremental_refresh(
    spark: SparkSession,
    store: StatsStore,
    documents: DataFrame,
    worklist: DataFrame,
    as_of: datetime | None = None,
    sync: DataFrame | None = None,
) -> DataFrame:
    """Refresh only the names of a work list; only their shards are rewritten."""
    version = store.next_version(spark)
    load_documents(
        spark, store, documents, version, "per-bucket", as_of, only=worklist, sync=sync
    )
    return run_counters(spark, store, version)


def refresh_once(
    spark: SparkSession,
    store: StatsStore,
    inv: DataFrame,
    documents: DataFrame,
    as_of: datetime,
    threshold_seconds: int = STALE_SECONDS,
    bulk_threshold: int = BULK_THRESHOLD,
    limit: int | None = None,
    landed: bool = False,
) -> DataFrame:
    """One collection cycle: plan it, refresh everything, only what is due, or nothing.

    ``limit`` holds for the per-entity mode only. Documents that have ``landed`` are not asked for
    again: they all apply, whatever the plan, which then only tells the mode. Returns one row with
    the counters of the run and the numbers of the plan.
    """
    cur = store.tables(spark).cur
    # the plan is one row; the choice needs its mode only
    plan = refresh_plan(inv, cur, as_of, threshold_seconds, bulk_threshold).first()
    mode = plan["mode"]
    if landed:
        version = store.next_version(spark)
        load_documents(spark, store, documents, version, mode, as_of)
        counters = run_counters(spark, store, version)
    elif mode == "bulk":
        counters = bulk_refresh(spark, store, documents, as_of)
    elif mode == "per-bucket":
        names = refresh_worklist(inv, cur, as_of, threshold_seconds, limit)
        counters = incremental_refresh(spark, store, documents, names, as_of)
    else:
        counters = spark.createDataFrame([(0, 0, 0, mode)], _COUNTERS)
    return counters.select(
        "*",
        *[F.lit(plan[name]).cast("bigint").alias(name) for name in ("total_buckets", "in_db", "to_update")],
    )


def repair(spark: SparkSession, store: StatsStore, as_of: datetime) -> DataFrame:
    """Give stored rows without a collection time the time ``as_of``; ``fetched`` counts them.

    Only the shards that hold such rows are rewritten.
    """
    version = store.next_version(spark)
    started = store.start_run(spark, version)
    cur = store.tables(spark).cur
    broken = cur.filter(F.col("collected_at").isNull())
    store.current.upsert(spark, repair_null_times(broken, as_of), version)
    zero = F.lit(0).cast("bigint")
    counters = repair_dry_run(cur).select(
        F.col("null_collected_at").alias("fetched"),
        zero.alias("collected"),
        zero.alias("errors"),
        F.lit("repair").alias("mode"),
    )
    _finish_run(spark, store, counters, version, started, None)
    return run_counters(spark, store, version)
