"""The registered queries: each operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelens.catalog import proxies as px
from usagelens.catalog.proxies import AS_OF, Proxies
from usagelens.functions.documents import usage_document, usage_total
from usagelens.functions.measures import BIGINT
from usagelens.functions.times import ntz
from usagelens.operators import (
    compare,
    export,
    growth,
    listing,
    maintenance,
    normalize,
    replication,
    summary,
    worklist,
)
from usagelens.plans import duty, refresh, reports, serving
from usagelens.schemas import CURRENT
from usagelens.session import work_dir
from usagelens.sinks.history import append_history, read_history
from usagelens.sources import borders, inventory, snapshots, sync, tables
from usagelens.sources.snapshots import ARRIVAL
from usagelens.streaming.refresh import feeds, refresh_feeds, refresh_folder, refresh_stream

Query = Callable[[SparkSession, str], DataFrame]
# Entity of the point lookups.
NAME = "bucket-3"
# Rows before this moment play what is stored, later ones what arrives.
ARRIVALS = datetime(2024, 1, 16)

_REGISTRY: dict[str, Query] = {}


def _query(function: Callable[[Proxies], DataFrame]) -> Callable[[Proxies], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(Proxies(spark, sf_dir))

    run.__doc__ = function.__doc__
    _REGISTRY[function.__name__.removesuffix("_query")] = run
    return function


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def _json_columns(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any engine can compare them."""
    nested = {
        "usage": F.to_json(usage_document(F.col("usage"))),
        "explicit_placement": F.to_json("explicit_placement"),
        "bucket_quota": F.to_json("bucket_quota"),
    }
    return rows.withColumns({n: c for n, c in nested.items() if n in rows.columns})


# --- ingest -------------------------------------------------------------------------


def _landed(p: Proxies, damaged: bool = True) -> DataFrame:
    documents = px.raw_documents(p.table("events"))
    return px.damaged_documents(documents) if damaged else documents


@_query
def ingest_snapshot(p: Proxies) -> DataFrame:
    parsed = snapshots.parse_documents(_landed(p).withColumnRenamed("id", "seq"))
    records = normalize.normalize(snapshots.good_documents(parsed), extra=["seq"])
    return records.select(
        "seq",
        "bucket_name",
        "bucket_id",
        "marker",
        "owner",
        "placement_rule",
        "num_shards",
        "index_type",
        "versioning",
        "versioned",
        "size_bytes",
        "size_actual_bytes",
        "size_utilized_bytes",
        "num_objects",
        "collected_at",
    )


@_query
def ingest_quarantine(p: Proxies) -> DataFrame:
    bad = snapshots.quarantine(snapshots.parse_documents(_landed(p).drop("id")))
    return bad.groupBy("reason").agg(
        F.count(F.lit(1)).alias("documents"), F.min("collected_at").alias("first_seen")
    )


@_query
def ingest_arrays(p: Proxies) -> DataFrame:
    """Array documents of one element and lone objects, split and parsed."""
    wrapped = F.when(F.col("id") % 2 == 0, F.concat(F.lit("[ 7, "), "value", F.lit("]"))).otherwise(
        F.col("value")
    )
    landed = _landed(p, damaged=False).withColumn("value", wrapped)
    split = snapshots.split_arrays(landed.withColumnRenamed("id", "seq"))
    good = snapshots.good_documents(snapshots.parse_documents(split))
    return normalize.normalize(good, extra=["seq"]).select(
        "seq", "bucket_name", "size_bytes", "num_objects", "collected_at"
    )


#: Documents of an array file, names of a list file.
PER_FILE = 2000


@_query
def ingest_cut_arrays(p: Proxies) -> DataFrame:
    """Array files of one line: of three, one ends in a document cut short, one behind a comma.

    What each file gives: its documents, their size, and rows that are no documents.
    """
    landed = _landed(p, damaged=False).withColumn("file", F.floor(F.col("id") / PER_FILE))
    is_last = F.max("id").over(Window.partitionBy("file")) == F.col("id")
    cut = F.when(is_last & (F.col("file") % 3 == 0), F.substring("value", 1, 40)).otherwise(F.col("value"))
    path = work_dir(p.spark, "arrays")
    px.write_lists(landed.withColumn("value", cut), path, F.col("file") % 3 != 1)
    items = borders.list_items(p.spark, path)
    documents = items.select("value", "collected_at", "broken", px.file_number().alias("file_number"))
    parsed = snapshots.parse_documents(documents)
    good = snapshots.readable() & snapshots.named()
    size = F.when(good, usage_total(F.col("usage"), "size"))
    return parsed.groupBy("file_number").agg(
        F.count_if(good).alias("documents"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("size_bytes"),
        F.count_if(~good).alias("unreadable"),
    )


@_query
def inventory_files(p: Proxies) -> DataFrame:
    """List files of names, numbers and objects; every seventh file lacks its end."""
    key = F.col("o_orderkey")
    name = F.concat(F.lit("bucket-"), key)
    value = (
        F.when(key % 4 == 0, F.concat(F.lit('{"bucket": "'), name, F.lit('", "tags": ["a", {"b": "],["}]}')))
        .when(key % 4 == 1, key.cast("string"))
        .otherwise(F.concat(F.lit('"'), name, F.lit('"')))
    )
    rows = p.table("orders").select(key.alias("id"), value.alias("value"), F.floor(key / PER_FILE).alias("file"))
    path = work_dir(p.spark, "inventory")
    px.write_lists(rows, path, F.col("file") % 7 == 0)
    items = borders.list_items(p.spark, path).withColumn("page", px.file_number())
    return inventory.listed_names(items, keep=["page"])


@_query
def ingest_one(p: Proxies) -> DataFrame:
    good = snapshots.good_documents(snapshots.parse_documents(_landed(p).drop("id")))
    records = normalize.normalize(snapshots.one_entity(good, NAME))
    return records.select("bucket_name", "owner", "size_bytes", "num_objects", "collected_at")


@_query
def inventory_names(p: Proxies) -> DataFrame:
    return inventory.inventory_names(px.inventory_pages(p.table("customer")), keep=["page"])


@_query
def sync_parse_json(p: Proxies) -> DataFrame:
    return sync.sync_from_json(px.sync_json_documents(p.table("events")))


@_query
def sync_parse_text(p: Proxies) -> DataFrame:
    return sync.sync_from_text(px.sync_text_documents(p.table("events")))


@_query
def sync_status_resolve(p: Proxies) -> DataFrame:
    return sync.sync_resolved(px.sync_fetches(p.table("events")))


@_query
def stats_with_sync(p: Proxies) -> DataFrame:
    """Two thirds of the entities get a fetched status, the others keep their own."""
    cur = p.cur().withColumn("sync_source_zone", F.lit(""))
    text = F.concat(F.col("num_objects"), F.lit(" shards behind\nsource zone: zone-1"))
    fetched = cur.filter(px.user_id_of() % 3 != 0).select("bucket_name", text.alias("value"))
    return sync.attach_sync(cur, sync.sync_from_text(fetched)).select(
        "bucket_name",
        "owner",
        "size_bytes",
        "sync_status",
        "sync_behind_shards",
        "sync_behind_entries",
        "sync_source_zone",
    )


# --- records and documents ----------------------------------------------------------


def _round_trip(p: Proxies) -> DataFrame:
    """Records exported as documents and read back."""
    cur = p.cur(wide=True)
    documents = cur.select("collected_at", normalize.document_text().alias("value"))
    return normalize.normalize(snapshots.good_documents(snapshots.parse_documents(documents)))


@_query
def normalize_stats(p: Proxies) -> DataFrame:
    scalars = [
        f.name
        for f in CURRENT.fields
        if f.name not in ("usage", "explicit_placement", "bucket_quota") and "sync" not in f.name
    ]
    return _round_trip(p).select(*scalars)


@_query
def usage_totals(p: Proxies) -> DataFrame:
    cur = p.cur(wide=True)
    measures = ["size", "size_actual", "size_utilized", "num_objects"]
    return cur.select(
        "bucket_name", *[usage_total(F.col("usage"), m).alias(f"total_{m}") for m in measures]
    )


@_query
def usage_explode(p: Proxies) -> DataFrame:
    return normalize.usage_rows(_round_trip(p))


@_query
def record_to_json(p: Proxies) -> DataFrame:
    return normalize.to_internal_json(p.cur(wide=True))


@_query
def export_one(p: Proxies) -> DataFrame:
    return export.export_one(p.cur(wide=True), NAME)


@_query
def export_all(p: Proxies) -> DataFrame:
    return export.export_all(p.cur(wide=True))


@_query
def export_text_missing(p: Proxies) -> DataFrame:
    return export.export_text(p.cur(wide=True), "no-such-bucket", pretty=False)


@_query
def export_text_found(p: Proxies) -> DataFrame:
    return export.export_text(p.cur(wide=True), NAME, pretty=False)


@_query
def export_files(p: Proxies) -> DataFrame:
    """All documents written to files, one a line, and read from there."""
    path = work_dir(p.spark, "export")
    export.write_documents(export.export_all(p.cur(wide=True)), path)
    return p.spark.read.text(path).withColumnRenamed("value", "document")


@_query
def normalize_all(p: Proxies) -> DataFrame:
    """All columns of the records, as a reader of one document sees them."""
    return _json_columns(normalize.with_defaults(_round_trip(p)))


# --- table maintenance --------------------------------------------------------------


def _arriving(p: Proxies, ts_from: datetime | None, ts_before: datetime | None) -> DataFrame:
    """History rows as updates; a third of them do not know the replication status."""
    rows = p.hist(ts_from, ts_before)
    k = F.floor(F.col("sync_behind_entries") / F.lit(10))
    known = k % 3 != 0
    return rows.select(
        "bucket_name",
        "size_bytes",
        "num_objects",
        F.when(known, F.when(k > 0, "behind").otherwise("synced")).alias("sync_status"),
        F.when(known, F.col("sync_behind_shards")).alias("sync_behind_shards"),
        "collected_at",
        "id",
    )


@_query
def upsert_current(p: Proxies) -> DataFrame:
    keys, order = ["bucket_name"], ["collected_at", "id"]
    carry = ["sync_status", "sync_behind_shards"]
    base = maintenance.latest_per_key(_arriving(p, None, ARRIVALS), keys, order, carry)
    return maintenance.merge_latest(base, _arriving(p, ARRIVALS, None), keys, order, carry)


@_query
def upsert_usage(p: Proxies) -> DataFrame:
    keys = ["bucket_name", "storage_class"]
    base = p.usage(ts_before=ARRIVALS)
    return maintenance.merge_latest(base, p.usage(ts_from=ARRIVALS), keys, ["collected_at"])


@_query
def append_history_query(p: Proxies) -> DataFrame:
    """Two appends, then the table as a reader sees it."""
    path = work_dir(p.spark, "history")
    append_history(p.hist(ts_before=ARRIVALS).drop("storage_class"), path, 1)
    append_history(p.hist(ts_from=ARRIVALS).drop("storage_class"), path, 2)
    rows = read_history(p.spark, path)
    return rows.withColumn("collected_date", F.col("collected_date").cast("string"))


def _store(p: Proxies) -> refresh.StatsStore:
    return refresh.StatsStore(work_dir(p.spark, "store"), shards=8)


def _documents(p: Proxies, damaged: bool = False) -> DataFrame:
    return _landed(p, damaged).withColumnRenamed("id", ARRIVAL)


_STATE = ["bucket_name", "owner", "num_shards", "size_bytes", "num_objects", "collected_at"]


@_query
def bulk_refresh(p: Proxies) -> DataFrame:
    return refresh.bulk_refresh(p.spark, _store(p), _documents(p, damaged=True))


@_query
def incremental_refresh(p: Proxies) -> DataFrame:
    """A first bulk load, then newer documents of the entities the work list names."""
    store, documents = _store(p), _documents(p)
    refresh.bulk_refresh(p.spark, store, documents.filter(F.col("collected_at") < ntz(ARRIVALS)))
    stored = store.current.read(p.spark)
    names = listing.stale_for_refresh(stored, ARRIVALS, 6 * 3600, limit=None)
    refresh.incremental_refresh(p.spark, store, documents, names)
    return store.current.read(p.spark).select(*_STATE)


@_query
def refresh_once(p: Proxies) -> DataFrame:
    """A first bulk load, then one planned cycle over the documents that arrive later."""
    store, documents = _store(p), _documents(p)
    refresh.bulk_refresh(p.spark, store, documents.filter(F.col("collected_at") < ntz(ARRIVALS)))
    later = documents.filter(F.col("collected_at") >= ntz(ARRIVALS))
    return refresh.refresh_once(p.spark, store, p.inv(), later, ARRIVALS)


@_query
def stream_refresh(p: Proxies) -> DataFrame:
    """The whole event stream applied in micro-batches; the final current rows."""
    store = _store(p)
    events = (
        p.spark.readStream.schema(px.SCHEMAS["events"])
        .option("pathGlobFilter", "events.parquet")
        .parquet(p.sf_dir)
    )
    documents = px.raw_documents(events).withColumnRenamed("id", ARRIVAL)
    query = refresh_stream(
        documents, store, f"{store.root}/checkpoint", f"{store.root}/serving", AS_OF, once=True
    )
    query.awaitTermination()
    return store.current.read(p.spark).select(*_STATE)


@_query
def refresh_landed(p: Proxies) -> DataFrame:
    """A per-entity cycle over documents that have landed: they all apply, also those not due."""
    store, documents = _store(p), _documents(p)
    refresh.bulk_refresh(p.spark, store, documents.filter(F.col("collected_at") < ntz(ARRIVALS)))
    later = documents.filter(F.col("collected_at") >= ntz(ARRIVALS))
    refresh.refresh_once(p.spark, store, p.inv(), later, ARRIVALS, bulk_threshold=5_000_000, landed=True)
    return store.current.read(p.spark).select(*_STATE)


@_query
def refresh_counters(p: Proxies) -> DataFrame:
    """What became of every landed row in a bulk run of odd documents and a run by list."""
    store, documents = _store(p), _documents(p, damaged=True)
    refresh.bulk_refresh(p.spark, store, documents)
    names = p.inv().filter(F.col("pos") % 3 == 0)
    refresh.incremental_refresh(p.spark, store, documents, names)
    return refresh.run_metrics(p.spark, store).drop("seconds", "stream", "batch")


@_query
def refresh_quarantine(p: Proxies) -> DataFrame:
    """What a bulk run set aside, as text, by reason."""
    store = _store(p)
    refresh.bulk_refresh(p.spark, store, _documents(p, damaged=True))
    bad = refresh.run_quarantine(p.spark, store)
    return bad.groupBy("version", "reason").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.char_length("value")).alias("characters"),
        F.max("collected_at").alias("last_seen"),
    )


def _spread_by_time(rows: DataFrame, path: str) -> None:
    """Files of one line per row, all of one landing time."""
    rows.select("value").write.text(path)


@_query
def stream_refresh_with_sync(p: Proxies) -> DataFrame:
    """Documents as lines and as list files, and replication status, in one query.

    The status of half the entities lands before their documents, that of the others after
    them, when the query is started again.
    """
    store, root = _store(p), work_dir(p.spark, "feeds")
    last = p.hist().groupBy("bucket_name").agg(F.max(F.struct("collected_at", "id"))["id"].alias("id"))
    docs = px.raw_documents(p.table("events")).join(last.select("id"), "id", "left_semi")
    user = F.regexp_extract("value", '"bucket":"bucket-([0-9]+)"', 1).cast("bigint")
    docs = docs.withColumn("user_id", user)
    _spread_by_time(docs.filter(user % 2 == 0), f"{root}/lines")
    px.write_lists(docs.filter(user % 2 == 1).withColumn("file", F.floor(user / 500)), f"{root}/arrays")
    stdout = F.concat(F.col("num_objects"), F.lit(" shards behind\n"), F.col("size_bytes"), F.lit("000000 entries behind\nsource zone: zone-1"))
    fetch = F.struct("bucket_name", F.lit(True).alias("ok"), stdout.alias("stdout"), F.lit("").alias("stderr"))
    status = p.hist().join(last.select("id"), "id", "left_semi").filter(px.user_id_of() % 3 != 0)
    texts = status.select(
        F.to_json(fetch.cast("struct<bucket:string,ok:boolean,stdout:string,stderr:string>")).alias("value"),
        (px.user_id_of() % 2).alias("late"),
    )
    folders = {"lines": f"{root}/lines", "arrays": f"{root}/arrays", "sync": f"{root}/sync"}
    _spread_by_time(texts.filter("late = 0"), f"{root}/sync")
    for late in (False, True):
        if late:
            texts.filter("late = 1").select("value").write.mode("append").text(f"{root}/sync")
        query = refresh_feeds(feeds(p.spark, **folders), store, f"{store.root}/checkpoint", once=True)
        query.awaitTermination()
    rows = store.current.read(p.spark)
    return rows.select("bucket_name", "size_bytes", "sync_status", "sync_behind_shards", "sync_behind_entries", "sync_source_zone")


@_query
def published_worklist(p: Proxies) -> DataFrame:
    """The list published after the second of two batches, long after: all that is stored is stale."""
    store, root = _store(p), work_dir(p.spark, "duty")
    user = px.user_id_of()
    last = p.hist().groupBy("bucket_name").agg(F.max(F.struct("collected_at", "id"))["id"].alias("id"))
    kept = last.filter(user % 4 != 0).select("id")
    docs = px.raw_documents(p.table("events")).join(kept, "id", "left_semi")
    for part in (0, 1):
        _spread_by_time(docs.filter(F.col("id") % 2 == part), f"{root}/landing/part={part}")
        query = refresh_folder(
            p.spark,
            f"{root}/landing/part=*",
            store,
            f"{store.root}/checkpoint",
            once=True,
            as_of=datetime(2100, 1, 1),
            duty_root=f"{root}/published",
            inventory=p.inv,
        )
        query.awaitTermination()
    return duty.read_worklist(p.spark, f"{root}/published")


@_query
def conform_schema(p: Proxies) -> DataFrame:
    """A table of an earlier release, without the later columns."""
    old = p.cur().drop("size_utilized_bytes", "num_shards")
    return _json_columns(maintenance.conform(old, CURRENT)).select(
        "bucket_name",
        "owner",
        "marker",
        "num_shards",
        "index_type",
        "versioned",
        "size_bytes",
        "size_utilized_bytes",
        "usage",
        "collected_at",
    )


@_query
def repair_null_ts(p: Proxies) -> DataFrame:
    repaired = maintenance.repair_null_times(p.cur_nulls(), AS_OF)
    return repaired.select("bucket_name", "owner", "size_bytes", "collected_at")


@_query
def repair_dry_run(p: Proxies) -> DataFrame:
    return maintenance.repair_dry_run(p.cur_nulls())


@_query
def serving_snapshot(p: Proxies) -> DataFrame:
    return serving.serving_snapshot(p.cur(), AS_OF)


def _published(p: Proxies) -> str:
    root = work_dir(p.spark, "serving")
    serving.publish_serving(p.cur(), root, 1, AS_OF - timedelta(seconds=90))
    return root


@_query
def serving_read(p: Proxies) -> DataFrame:
    return serving.read_section(p.spark, _published(p), "top_by_size", limit=10)


@_query
def serving_read_all(p: Proxies) -> DataFrame:
    return serving.read_section(p.spark, _published(p), "all_buckets")


@_query
def serving_read_table(p: Proxies) -> DataFrame:
    """All rows as a snapshot shows them that was published with its table after a refresh."""
    store, root = _store(p), work_dir(p.spark, "serving")
    refresh.bulk_refresh(p.spark, store, _documents(p))
    cur = store.tables(p.spark).cur
    version = store.last_version(p.spark)
    serving.publish_serving(cur, root, version, AS_OF, table=store.current, table_version=version)
    return serving.read_section(p.spark, root, "all_buckets")


@_query
def serving_age(p: Proxies) -> DataFrame:
    return serving.serving_age(p.spark, _published(p), AS_OF)


# --- lookups, lists, top-k ----------------------------------------------------------


@_query
def entity_row(p: Proxies) -> DataFrame:
    return _json_columns(listing.entity_row(p.cur(wide=True), NAME))


@_query
def entity_details(p: Proxies) -> DataFrame:
    rows = listing.entity_details(p.cur(wide=True), NAME)
    return rows.withColumn("storage_classes", F.array_join("storage_classes", ","))


@_query
def entity_history(p: Proxies) -> DataFrame:
    return listing.entity_history(p.hist(), NAME, AS_OF)


@_query
def entity_history_last_n(p: Proxies) -> DataFrame:
    return listing.entity_history_last(p.hist(), NAME, AS_OF)


@_query
def top_by_size(p: Proxies) -> DataFrame:
    return listing.top_by_size(p.cur())


@_query
def top_by_objects(p: Proxies) -> DataFrame:
    return listing.top_by_objects(p.cur())


@_query
def listing_by_size(p: Proxies) -> DataFrame:
    return listing.listing(p.cur(), AS_OF, "size")


@_query
def listing_by_objects(p: Proxies) -> DataFrame:
    return listing.listing(p.cur(), AS_OF, "objects")


@_query
def listing_by_age(p: Proxies) -> DataFrame:
    return listing.listing(p.cur_nulls(), AS_OF, "age")


@_query
def listing_by_name(p: Proxies) -> DataFrame:
    return listing.listing(p.cur(), AS_OF, "name")


@_query
def all_entities(p: Proxies) -> DataFrame:
    return listing.all_entities(p.cur())


@_query
def empty_entities(p: Proxies) -> DataFrame:
    return listing.empty_entities(p.cur_empty())


@_query
def stale_for_refresh(p: Proxies) -> DataFrame:
    return listing.stale_for_refresh(p.cur_nulls(), AS_OF, summary.STALE_SECONDS)


@_query
def stale_report(p: Proxies) -> DataFrame:
    return listing.stale_report(p.cur_nulls(), AS_OF)


# --- summaries ----------------------------------------------------------------------


@_query
def cluster_summary(p: Proxies) -> DataFrame:
    return summary.cluster_summary(p.cur())


@_query
def summary_by_owner(p: Proxies) -> DataFrame:
    return summary.summary_by_owner(p.cur())


@_query
def summary_by_owner_all(p: Proxies) -> DataFrame:
    return summary.summary_by_owner(p.cur(), limit=None)


@_query
def storage_class_distribution(p: Proxies) -> DataFrame:
    return summary.storage_class_distribution(p.usage())


@_query
def collection_freshness(p: Proxies) -> DataFrame:
    return summary.collection_freshness(p.cur_nulls(), AS_OF)


@_query
def freshness_bands(p: Proxies) -> DataFrame:
    return summary.freshness_bands(p.cur_nulls(), AS_OF)


@_query
def stale_count(p: Proxies) -> DataFrame:
    return summary.stale_count(p.cur_nulls(), AS_OF)


@_query
def stale_ladder(p: Proxies) -> DataFrame:
    return summary.stale_ladder(p.cur_nulls(), AS_OF)


@_query
def timestamp_health(p: Proxies) -> DataFrame:
    return summary.timestamp_health(p.cur_nulls())


@_query
def status_rollup(p: Proxies) -> DataFrame:
    return summary.status_rollup(p.cur_nulls(), AS_OF)


# --- growth and comparison ----------------------------------------------------------


@_query
def cluster_growth(p: Proxies) -> DataFrame:
    return growth.cluster_growth(p.hist(), AS_OF, total_type=BIGINT)


@_query
def cluster_growth_eod(p: Proxies) -> DataFrame:
    return growth.cluster_growth(p.hist(), AS_OF, basis=growth.END_OF_DAY, total_type=BIGINT)


@_query
def fastest_growing_entities(p: Proxies) -> DataFrame:
    return growth.fastest_growing_entities(p.hist(), p.cur(), AS_OF)


@_query
def fastest_growing_owners(p: Proxies) -> DataFrame:
    return growth.fastest_growing_owners(p.hist(), p.cur(), AS_OF, total_type=BIGINT)


@_query
def first_last_per_entity(p: Proxies) -> DataFrame:
    return growth.first_last_per_entity(p.hist(), ["size_bytes", "num_objects"])


@_query
def capacity_forecast(p: Proxies) -> DataFrame:
    return _rounded(growth.capacity_forecast(p.hist(), AS_OF, total_type=BIGINT))


@_query
def capacity_forecast_eod(p: Proxies) -> DataFrame:
    return _rounded(growth.capacity_forecast(p.hist(), AS_OF, basis=growth.END_OF_DAY, total_type=BIGINT))


@_query
def capacity_forecast_by_entity(p: Proxies) -> DataFrame:
    return _rounded(growth.capacity_forecast(p.hist(), AS_OF, by=["bucket_name"], total_type=BIGINT))


def _rounded(forecast: DataFrame) -> DataFrame:
    names = ["forecast_bytes", "daily_growth_bytes", "monthly_growth_bytes"]
    return forecast.withColumns({n: F.round(n, 4) for n in names})


def _huge(p: Proxies) -> DataFrame:
    """The history with sizes so large that the sum of a few is past 2^63."""
    return p.hist().withColumn("size_bytes", F.col("size_bytes") + F.lit(2**62))


def _as_text(rows: DataFrame, *names: str) -> DataFrame:
    """Totals as text: engines differ in how they hand over wide numbers."""
    return rows.withColumns({n: F.col(n).cast("string") for n in names})


@_query
def cluster_growth_wide(p: Proxies) -> DataFrame:
    return _as_text(growth.cluster_growth(_huge(p), AS_OF), "total_size", "total_objects")


@_query
def fastest_growing_owners_wide(p: Proxies) -> DataFrame:
    rows = growth.fastest_growing_owners(_huge(p), p.cur(), AS_OF, limit=100)
    return _as_text(rows, "start_size", "end_size", "growth_bytes")


@_query
def capacity_forecast_wide(p: Proxies) -> DataFrame:
    rows = growth.capacity_forecast(_huge(p), AS_OF)
    return _as_text(rows, "current_bytes").select("current_bytes", "data_points", "error")


@_query
def compare_snapshots(p: Proxies) -> DataFrame:
    return compare.compare_snapshots(p.cur(), p.hist(), AS_OF)


@_query
def entity_changes(p: Proxies) -> DataFrame:
    changes = compare.entity_changes(p.hist(), p.cur(), AS_OF)
    return changes.withColumn("change_pct", F.round("change_pct", 6))


@_query
def entity_comparison(p: Proxies) -> DataFrame:
    rows = compare.entity_comparison(p.cur(), p.hist(), AS_OF)
    return rows.withColumn("size_pct_change", F.round("size_pct_change", 6))


# --- replication --------------------------------------------------------------------


@_query
def sync_status_summary(p: Proxies) -> DataFrame:
    return replication.sync_status_summary(p.cur())


@_query
def lagging_by_shards(p: Proxies) -> DataFrame:
    return replication.lagging_by_shards(p.cur())


@_query
def lagging_by_entries(p: Proxies) -> DataFrame:
    return replication.lagging_by_entries(p.cur())


@_query
def sync_comparison(p: Proxies) -> DataFrame:
    rows = replication.sync_comparison(p.cur(), p.hist(), AS_OF)
    return rows.withColumn("avg_shards_24h", F.round("avg_shards_24h", 6))


# --- work lists ---------------------------------------------------------------------


@_query
def uncollected(p: Proxies) -> DataFrame:
    return worklist.uncollected(p.inv(), p.cur())


@_query
def uncollected_all(p: Proxies) -> DataFrame:
    return worklist.uncollected(p.inv(), p.cur(), limit=None)


@_query
def refresh_worklist(p: Proxies) -> DataFrame:
    return worklist.refresh_worklist(p.inv(), p.cur_nulls(), AS_OF)


@_query
def refresh_worklist_prioritised(p: Proxies) -> DataFrame:
    return worklist.refresh_worklist_prioritised(p.inv(), p.cur_nulls(), AS_OF, limit=1400)


@_query
def refresh_plan(p: Proxies) -> DataFrame:
    return worklist.refresh_plan(p.inv(), p.cur_nulls(), AS_OF)


@_query
def refresh_plan_per_bucket(p: Proxies) -> DataFrame:
    return worklist.refresh_plan(p.inv(), p.cur_nulls(), AS_OF, bulk_threshold=5_000_000)


# --- reports and free SQL -----------------------------------------------------------


@_query
def listing_report(p: Proxies) -> DataFrame:
    return reports.listing_report(p.cur_nulls(), AS_OF)


@_query
def top_report(p: Proxies) -> DataFrame:
    return reports.top_report(p.cur(), AS_OF)


@_query
def comparison_report(p: Proxies) -> DataFrame:
    return reports.comparison_report(p.cur(), p.hist(), AS_OF)


@_query
def sync_report(p: Proxies) -> DataFrame:
    rows = reports.sync_report(p.cur(), p.hist(), AS_OF)
    return rows.withColumn("avg_shards_24h", F.round("avg_shards_24h", 6))


@_query
def growth_report(p: Proxies) -> DataFrame:
    return reports.growth_report(p.hist(), p.cur(), AS_OF)


@_query
def forecast_report(p: Proxies) -> DataFrame:
    return reports.forecast_report(p.hist(), AS_OF)


@_query
def freshness_report(p: Proxies) -> DataFrame:
    return reports.freshness_report(p.cur(), AS_OF)


@_query
def oldest_report(p: Proxies) -> DataFrame:
    return reports.oldest_report(p.cur(), AS_OF)


@_query
def custom_sql(p: Proxies) -> DataFrame:
    usage = tables.Tables(p.cur(), p.hist(), p.usage(), p.inv())
    return tables.custom_sql(
        p.spark,
        usage,
        """
        SELECT s.owner, u.storage_class, count(*) AS buckets, sum(u.size_bytes) AS size_bytes
        FROM bucket_stats s JOIN storage_class_usage u USING (bucket_name)
        WHERE u.num_objects >= :least
        GROUP BY s.owner, u.storage_class
        """,
        least=5,
    )


# --- larger histories ---------------------------------------------------------------


@_query
def cluster_growth_lineitem(p: Proxies) -> DataFrame:
    return growth.cluster_growth(p.hist_lineitem(), px.AS_OF_LINEITEM, days=365, total_type=BIGINT)


@_query
def first_last_lineitem(p: Proxies) -> DataFrame:
    return growth.first_last_per_entity(p.hist_lineitem(), ["size_bytes", "num_objects"])


@_query
def forecast_by_entity_lineitem(p: Proxies) -> DataFrame:
    return _rounded(
        growth.capacity_forecast(
            p.hist_lineitem(), px.AS_OF_LINEITEM, history_days=3650, by=["bucket_name"], total_type=BIGINT
        )
    )


@_query
def upsert_orders(p: Proxies) -> DataFrame:
    """Latest row per customer; some have several rows at the same time."""
    return maintenance.latest_per_key(p.hist_orders(), ["bucket_name"], ["collected_at", "id"])


