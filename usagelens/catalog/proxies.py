"""The driver's tables seen as usage statistics.

``events`` plays the history, ``customer`` and ``nation`` the entities and their owners.
``lineitem`` and ``orders`` are larger histories for the bench.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from usagelens.functions.times import ntz
from usagelens.operators.maintenance import latest_per_key
from usagelens.schemas import CLASS_USAGE, CURRENT, USAGE

# Columns of the driver's tables that the proxies use. With a given schema a read needs no
# job that looks into a file first.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, "
    "l_extendedprice double, l_shipdate timestamp_ntz",
}

AS_OF = datetime(2024, 1, 31)
AS_OF_LINEITEM = datetime(2001, 11, 5)


class Proxies:
    """Builds each table lazily; unused columns are pruned before the scan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def _events(self, ts_from: datetime | None = None, ts_before: datetime | None = None):
        events = self.table("events")
        if ts_from is not None:
            events = events.filter(F.col("ts") >= ntz(ts_from))
        if ts_before is not None:
            events = events.filter(F.col("ts") < ntz(ts_before))
        return events

    def hist(self, ts_from: datetime | None = None, ts_before: datetime | None = None) -> DataFrame:
        return hist_columns(self._events(ts_from, ts_before))

    def cur(
        self,
        ts_from: datetime | None = None,
        ts_before: datetime | None = None,
        wide: bool = False,
    ) -> DataFrame:
        """Latest row per entity with its owner. ``wide`` adds the columns only the lookups
        and the export need (among them the usage map, which costs a second aggregation).
        """
        rank = F.struct("ts", "event_id")
        latest = self._events(ts_from, ts_before).groupBy("user_id").agg(
            F.max_by("value", rank).alias("value"),
            F.max_by("props", rank).alias("props"),
            F.max("ts").alias("ts"),
        )
        owners = self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        rows = latest.join(owners, F.col("user_id") == F.col("c_custkey"))
        if wide:
            maps = usage_maps(self.usage(ts_from, ts_before))
            rows = rows.join(maps, bucket_name() == maps["bucket_name"]).drop("bucket_name")
        return current_columns(rows, wide)

    def usage(
        self, ts_from: datetime | None = None, ts_before: datetime | None = None
    ) -> DataFrame:
        return usage_columns(self._events(ts_from, ts_before))

    def inv(self) -> DataFrame:
        return self.table("customer").select(
            F.concat(F.lit("bucket-"), "c_custkey").alias("bucket_name"),
            F.col("c_custkey").alias("pos"),
        )

    def cur_nulls(self) -> DataFrame:
        """Some rows without a collection time."""
        gone = user_id_of() % 37 == 0
        return self.cur().withColumn(
            "collected_at", F.when(~gone, F.col("collected_at"))
        )

    def cur_empty(self) -> DataFrame:
        """Some entities without objects."""
        gone = user_id_of() % 13 == 0
        return self.cur().withColumn(
            "num_objects", F.when(gone, F.lit(0).cast("bigint")).otherwise(F.col("num_objects"))
        )

    def hist_lineitem(self) -> DataFrame:
        """A six times larger history: one entity per part."""
        place = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")
        return self.table("lineitem").select(
            place,
            F.concat(F.lit("bucket-"), "l_partkey").alias("bucket_name"),
            F.floor(F.col("l_extendedprice") * 100).alias("size_bytes"),
            F.col("l_linenumber").cast("bigint").alias("num_objects"),
            F.col("l_shipdate").alias("collected_at"),
        )

    def hist_orders(self) -> DataFrame:
        """One entity per customer."""
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("bucket-"), "o_custkey").alias("bucket_name"),
            F.floor(F.col("o_totalprice") * 100).alias("size_bytes"),
            F.lit(1).cast("bigint").alias("num_objects"),
            F.col("o_orderdate").alias("collected_at"),
        )


def bucket_name() -> Column:
    return F.concat(F.lit("bucket-"), F.col("user_id"))


def user_id_of() -> Column:
    return F.substring_index("bucket_name", "-", -1).cast("bigint")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _size() -> Column:
    return F.floor(F.col("value") * 1024)


def _actual(size: Column) -> Column:
    """Size rounded up to whole 4096-byte blocks."""
    return (F.ceil(size / F.lit(4096.0)) * 4096).cast("bigint")


def hist_columns(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        bucket_name().alias("bucket_name"),
        _size().alias("size_bytes"),
        F.floor("value").alias("num_objects"),
        (_k() % 10).cast("bigint").alias("sync_behind_shards"),
        (_k() * 10).cast("bigint").alias("sync_behind_entries"),
        F.col("ts").alias("collected_at"),
        F.col("event_type").alias("storage_class"),
    )


def current_columns(rows: DataFrame, wide: bool = False) -> DataFrame:
    """Rows with ``user_id, value, props, ts, n_name`` -> record columns."""
    user = F.col("user_id")
    size = _size()
    status = (
        F.when(user % 7 == 0, "")
        .when(user % 11 == 0, None)
        .when(_k() > 0, "behind")
        .otherwise("synced")
    )
    narrow = {
        "bucket_name": bucket_name(),
        "owner": F.col("n_name"),
        "num_shards": (F.lit(11) + user % 5).cast("int"),
        "size_bytes": size,
        "size_actual_bytes": _actual(size),
        "size_utilized_bytes": size,
        "num_objects": F.floor("value"),
        "sync_status": status,
        "sync_behind_shards": (_k() % 10).cast("bigint"),
        "sync_behind_entries": (_k() * 10).cast("bigint"),
        "collected_at": F.col("ts"),
    }
    if not wide:
        return rows.select(*[c.alias(name) for name, c in narrow.items()])
    ident = F.concat(F.lit("id-"), user)
    full = {
        **narrow,
        "bucket_id": ident,
        "marker": F.when(user % 2 == 0, "").otherwise(ident),
        "zonegroup": F.lit("zg"),
        "placement_rule": F.lit("default-placement"),
        "index_type": F.lit("Normal"),
        "versioning": F.when(user % 5 != 0, "off"),
        "usage": F.col("usage"),
        "sync_source_zone": F.lit(""),
        "collection_duration_ms": F.lit(0),
    }
    for field in CURRENT.fields:
        if field.name not in full:
            fill = {T.StringType: "", T.BooleanType: False}.get(type(field.dataType))
            full[field.name] = F.lit(fill)
    return rows.select(*[full[f.name].cast(f.dataType).alias(f.name) for f in CURRENT.fields])


def usage_columns(events: DataFrame) -> DataFrame:
    """Latest row per (entity, class)."""
    latest = latest_per_key(
        events.select("user_id", "event_type", "value", "ts", "event_id"),
        ["user_id", "event_type"],
        ["ts", "event_id"],
    )
    size = _size()
    return latest.select(
        bucket_name().alias("bucket_name"),
        F.col("event_type").alias("storage_class"),
        size.alias("size_bytes"),
        _actual(size).alias("size_actual_bytes"),
        size.alias("size_utilized_bytes"),
        F.floor("value").alias("num_objects"),
        F.col("ts").alias("collected_at"),
    ).select(*CLASS_USAGE.names)


def usage_maps(usage: DataFrame) -> DataFrame:
    """``bucket_name, usage``: the classes of one entity as a map, in name order.

    The map is part of the record; its size is the number of storage classes, and there is
    one row per (entity, class), so the collected list is as small as the record itself.
    """
    known = {
        "size": "size_bytes",
        "size_actual": "size_actual_bytes",
        "size_utilized": "size_utilized_bytes",
        "num_objects": "num_objects",
    }
    measures = F.struct(
        *[
            (F.col(known[n]) if n in known else F.lit(None)).cast("bigint").alias(n)
            for n in USAGE.names
        ]
    )
    pairs = F.array_sort(F.collect_list(F.struct("storage_class", measures)))
    return usage.groupBy("bucket_name").agg(F.map_from_entries(pairs).alias("usage"))


def raw_documents(events: DataFrame) -> DataFrame:
    """One landed document per history row: ``value`` (JSON text), ``collected_at``, ``id``."""
    user, size = F.col("user_id"), _size()
    measures = F.struct(
        size.alias("size"),
        _actual(size).alias("size_actual"),
        size.alias("size_utilized"),
        F.floor("value").alias("num_objects"),
    )
    document = F.struct(
        bucket_name().alias("bucket"),
        (F.lit(11) + user % 5).alias("num_shards"),
        F.concat(F.lit("id-"), user).alias("id"),
        F.lit("default-placement").alias("placement_rule"),
        F.concat(F.lit("user-"), user % 10).alias("owner"),
        F.create_map(F.col("event_type"), measures).alias("usage"),
    )
    return events.select(
        F.to_json(document).alias("value"),
        F.col("ts").alias("collected_at"),
        F.col("event_id").alias("id"),
    )


def damaged_documents(documents: DataFrame) -> DataFrame:
    """The same documents, some of them odd in one way or another, by ``id``."""
    text, i = F.col("value"), F.col("id")

    def swap(old: str, new: str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new))

    value = (
        F.when(i % 17 == 0, F.substring("value", 1, 20))
        .when(i % 19 == 0, swap('"bucket":', '"other":'))
        .when(i % 23 == 0, swap('"usage":{', '"usage":{"note":"none",'))
        .when(i % 29 == 0, swap('"size_utilized":', '"other":'))
        .when(i % 31 == 0, swap('"num_shards":', '"num_shards":null,"other":'))
        .when(i % 37 == 0, swap('"num_shards":', '"num_shards":"many","other":'))
        .when(i % 41 == 0, F.lit("[1, 2]"))
        .when(i % 43 == 0, swap('"owner":', '"num_objects":'))
        .otherwise(text)
    )
    return documents.withColumn("value", value)


def write_lists(rows: DataFrame, path: str, unfinished: Column | None = None) -> None:
    """Files ``file=<n>`` of one line each: the JSON texts ``value`` of a file as one list, by ``id``.

    ``unfinished`` (on ``file``) names the files that lack the end of their list.
    """
    by = Window.partitionBy("file")
    place = F.row_number().over(by.orderBy("id"))
    placed = rows.select("file", "id", "value", place.alias("place"), F.count(F.lit(1)).over(by).alias("places"))
    begin = F.when(F.col("place") == 1, "[").otherwise("")
    last = F.when(F.col("place") < F.col("places"), ",").otherwise("]")
    if unfinished is not None:
        last = F.when(unfinished, ",").otherwise(last)
    texts = placed.select("file", "id", F.concat(begin, "value", last).alias("value"))
    # rows are written in order of their place; a blank stands between them
    sorted_ = texts.repartition("file").sortWithinPartitions("file", "id").drop("id")
    sorted_.write.partitionBy("file").option("lineSep", " ").text(path)


def file_number() -> Column:
    return F.regexp_extract("file", "/file=([0-9]+)/", 1).cast("bigint")


def inventory_pages(customer: DataFrame) -> DataFrame:
    """Listing pages of at most 100 elements (keys are unique): strings, objects, others."""
    key = F.col("c_custkey")
    name = F.concat(F.lit("bucket-"), key)
    kind = key % 5
    element = (
        F.when(kind == 0, F.concat(F.lit('"'), name, F.lit('"')))
        .when(kind == 1, F.concat(F.lit('{"bucket":"'), name, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"name":"'), name, F.lit('","bucket":null}')))
        .when(kind == 3, F.concat(F.lit('{"bucket":"","name":"'), name, F.lit('"}')))
        .otherwise(key.cast("string"))
    )
    page = F.floor(key / F.lit(100)).alias("page")
    elements = F.array_sort(F.collect_list(F.struct("c_custkey", element.alias("element"))))
    texts = F.transform(elements, lambda e: e["element"])
    return (
        customer.groupBy(page)
        .agg(F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]")).alias("value"))
    )


def _with_k(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), bucket_name().alias("bucket_name"), _k().alias("k")
    )


def sync_json_documents(events: DataFrame) -> DataFrame:
    """A zone list per history row: ``id, value``; some are objects, empty, or hold junk."""
    rows, k, i = _with_k(events), F.col("k"), F.col("id")
    zone = F.struct(
        F.concat(F.lit("zone-"), k % 3).alias("source_zone"),
        (k % 10).alias("shards_behind"),
        F.when(i % 2 == 0, k * 10).alias("entries_behind"),
    )
    unnamed = F.struct(
        F.lit("").alias("source_zone"),
        (k % 2).alias("shards_behind"),
        F.lit(None).cast("int").alias("entries_behind"),
    )
    listed = F.to_json(F.array(zone, unnamed), {"ignoreNullFields": "false"})
    value = (
        F.when(i % 7 == 0, '{"source_zone":"zone-9","shards_behind":4}')
        .when(i % 11 == 0, "[]")
        .when(i % 13 == 0, F.concat(F.lit("[5,"), F.substring(listed, 2, 2**30)))
        .otherwise(listed)
    )
    return rows.select("id", value.alias("value"))


def sync_text_documents(events: DataFrame) -> DataFrame:
    """A free-text status per history row: ``id, value``; five kinds."""
    rows, k = _with_k(events), F.col("k")
    kind = F.col("id") % 5
    value = (
        F.when(
            kind == 0,
            F.concat(
                k % 10,
                F.lit(" shards behind\n"),
                k * 10,
                F.lit(" entries  behind\nsource zone: zone-"),
                k % 3,
            ),
        )
        .when(kind == 1, F.concat(k % 10, F.lit(" SHARD behind")))
        .when(kind == 2, F.concat(F.lit("Source Zone zone-7\nCaught up; "), k, F.lit(" shards behind")))
        .when(kind == 3, F.concat(F.lit("found "), k, F.lit(" Errors; in sync")))
        .otherwise(F.concat(k, F.lit(" entry behind")))
    )
    return rows.select("id", value.alias("value"))


def sync_fetches(events: DataFrame) -> DataFrame:
    """Fetch results per history row: ``id, ok, stdout, stderr``; six kinds."""
    rows, k = _with_k(events), F.col("k")
    kind = F.col("id") % 6
    shards = F.concat(F.lit('[{"source_zone":"zone-1","shards_behind":'), k % 10, F.lit("}]"))
    stdout = (
        F.when(kind == 0, shards)
        .when(kind == 1, F.concat(k, F.lit(" entries behind")))
        .when(kind == 4, "[broken")
    )
    stderr = (
        F.when(kind == 2, "ERROR: zone is NOT in a multisite setup")
        .when(kind == 3, "timed out")
        .when(kind == 5, "No sync policy")
        .otherwise("")
    )
    ok = kind.isin(0, 1, 4)
    return rows.select("id", ok.alias("ok"), stdout.alias("stdout"), stderr.alias("stderr"))
