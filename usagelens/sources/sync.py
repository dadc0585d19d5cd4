"""Replication status documents (JSON or free text) -> four status columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelens.schemas import SYNC_COLUMNS

LEAST, MOST = -(2**63), 2**63 - 1
ZONE = "struct<source_zone:string,shards_behind:bigint,entries_behind:bigint>"

# Patterns and phrases of the text form, matched without case.
SHARDS_PATTERN = r"(?i)(\d+)\s+shards?\s+behind"
ENTRIES_PATTERN = r"(?i)(\d+)\s+entries?\s+behind"
ZONE_PATTERN = r"(?i)source\s+zone[:\s]+(\S+)"
ERROR_PHRASE = "error"
SYNCED_PHRASES = ["caught up", "in sync"]
SINGLE_SITE_PHRASES = ["not in a multisite", "no sync"]


def _contains(text: Column, phrases: list[str]) -> Column:
    low = F.lower(text)
    found = low.contains(phrases[0])
    for phrase in phrases[1:]:
        found |= low.contains(phrase)
    return found


def _zones(text: Column) -> Column:
    """The zones of a list document; NULL for anything that is not a readable list."""
    is_list = F.ltrim(text).startswith("[")  # from_json also reads a lone object as a list
    whole = F.from_json(text, f"array<{ZONE}>")
    # an element that is no object voids the whole list; only then are they parsed one by one
    elements = F.from_json(text, "array<string>")
    objects = F.filter(elements, lambda e: F.ltrim(e).startswith("{"))
    single = F.transform(objects, lambda e: F.from_json(e, ZONE))
    return F.when(is_list, F.coalesce(whole, single))


def _whole(number: Column) -> Column:
    """A bigint; beyond it, the largest there is."""
    return F.greatest(F.lit(LEAST), F.least(F.lit(MOST), number)).cast("bigint")


def _with_json(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_zones`` and, in a second step so that the text is parsed once, its sums."""
    df = df.withColumn("_zones", _zones(text))
    zero = F.lit(0).cast("decimal(38,0)")

    def lag(field: str) -> Column:
        total = F.aggregate("_zones", zero, lambda acc, z: (acc + F.coalesce(z[field], F.lit(0))).cast("decimal(38,0)"))
        return _whole(F.coalesce(total, zero))

    named = F.filter("_zones", lambda z: z["source_zone"] != "")
    return df.withColumns(
        {
            "_json_shards": lag("shards_behind"),
            "_json_entries": lag("entries_behind"),
            "_json_zone": F.try_element_at(named, F.lit(-1))["source_zone"],
        }
    )


def _with_text(df: DataFrame, text: Column) -> DataFrame:
    """Adds the numbers and the zone found by pattern; NULL where there is none."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    def number(pattern: str) -> Column:
        digits = found(pattern)
        # more digits than a decimal holds are beyond the range, too
        return F.when(digits.isNotNull(), F.coalesce(_whole(digits.try_cast("decimal(38,0)")), F.lit(MOST)))

    return df.withColumns(
        {
            "_text_shards": number(SHARDS_PATTERN),
            "_text_entries": number(ENTRIES_PATTERN),
            "_text_zone": found(ZONE_PATTERN),
        }
    )


def _json_status() -> Column:
    lagging = (F.col("_json_shards") > 0) | (F.col("_json_entries") > 0)
    return F.when(lagging, "behind").otherwise("synced")


def _text_status(text: Column) -> Column:
    """``error`` wins, then the in-sync phrases, then a number found."""
    behind = F.col("_text_shards").isNotNull() | F.col("_text_entries").isNotNull()
    return (
        F.when(_contains(text, [ERROR_PHRASE]), "error")
        .when(_contains(text, SYNCED_PHRASES), "synced")
        .when(behind, "behind")
        .otherwise("synced")
    )


def _sync_columns(df: DataFrame, keep: list[str], values: list[Column]) -> DataFrame:
    status, shards, entries, zone = values
    columns = [
        status,
        # a lag past the column's range becomes its largest value instead of failing the whole job
        F.coalesce(shards, F.lit(0)).cast("bigint"),
        F.coalesce(entries, F.lit(0)).cast("bigint"),
        F.coalesce(zone, F.lit("")),
    ]
    return df.select(*keep, *[c.alias(n) for n, c in zip(SYNC_COLUMNS, columns, strict=True)])


def sync_from_json(df: DataFrame, value: str = "value") -> DataFrame:
    """Lag summed over the zones of a list; anything but a list counts as in sync.

    The text column is replaced by the four status columns.
    """
    keep = [c for c in df.columns if c != value]
    parsed = _with_json(df, F.col(value))
    values = [_json_status(), F.col("_json_shards"), F.col("_json_entries"), F.col("_json_zone")]
    return _sync_columns(parsed, keep, values)


def sync_from_text(df: DataFrame, value: str = "value") -> DataFrame:
    """Numbers and zone by pattern, status by phrase. The text column is replaced."""
    keep = [c for c in df.columns if c != value]
    parsed = _with_text(df, F.col(value))
    status = _text_status(F.col(value))
    values = [status, F.col("_text_shards"), F.col("_text_entries"), F.col("_text_zone")]
    return _sync_columns(parsed, keep, values)


def sync_resolved(
    df: DataFrame, ok: str = "ok", stdout: str = "stdout", stderr: str = "stderr"
) -> DataFrame:
    """The status of a fetch from its JSON or text output, or from the kind of failure."""
    keep = [c for c in df.columns if c not in (ok, stdout, stderr)]
    out = F.when(F.col(ok), F.col(stdout))
    is_list, is_object = F.trim(out).startswith("["), F.trim(out).startswith("{")
    parsed = _with_json(df, F.when(is_list, out))
    parsed = _with_text(parsed, F.when(~is_list & ~is_object, out))
    single_site = ~F.col(ok) & _contains(F.col(stderr), SINGLE_SITE_PHRASES)
    broken = (is_list & F.col("_zones").isNull()) | (is_object & F.try_parse_json(out).isNull())
    status = (
        F.when(single_site, "not_multisite")
        .when(out.isNull() | broken, "unknown")
        .when(is_list | is_object, _json_status())
        .otherwise(_text_status(out))
    )
    values = [status] + [
        F.when(is_list, F.col(f"_json_{part}")).otherwise(F.col(f"_text_{part}"))
        for part in ("shards", "entries", "zone")
    ]
    return _sync_columns(parsed, keep, values)


def attach_sync(stats: DataFrame, sync: DataFrame) -> DataFrame:
    """Copy the status columns onto the records; without a status the record keeps its own.

    ``sync`` has one row per entity. The columns are one reading: all come from it or none.
    """
    known = F.col(SYNC_COLUMNS[0]).isNotNull().alias("_known")
    renamed = sync.select("bucket_name", F.struct(*SYNC_COLUMNS).alias("_reading"), known)
    joined = stats.join(renamed, "bucket_name", "left")
    return joined.select(
        *[
            F.when(F.col("_known"), F.col(f"_reading.{c}")).otherwise(F.col(c)).alias(c)
            if c in SYNC_COLUMNS
            else F.col(c)
            for c in stats.columns
        ]
    )
