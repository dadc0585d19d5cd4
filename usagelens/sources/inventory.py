"""Entity inventory: a listing of names as JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.sources.borders import list_items


def _name(item: str) -> Column:
    """The name in a variant: a string, or an object's ``bucket``, else its ``name``."""
    kind = F.schema_of_variant(item)

    def field(key: str) -> Column:
        return F.nullif(F.try_variant_get(item, f"$.{key}", "string"), F.lit(""))

    # VARIANT keeps the type: the number 5 and the text "5" stay apart
    return F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(
        kind.startswith("OBJECT<"), F.coalesce(field("bucket"), field("name"))
    )


def listed_names(items: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Elements of list files -> ``bucket_name`` with its position ``pos`` in its file."""
    rows = items.filter(F.col("listed") & ~F.col("broken"))
    rows = rows.select(*(keep or []), "pos", F.try_parse_json("value").alias("item"))
    return rows.select(*(keep or []), "pos", _name("item").alias("bucket_name")).filter(
        F.col("bucket_name").isNotNull()
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array per file (a listing or a page of one), of any size: a file is read by many
    tasks, and each name finds its place by its offset in the file.
    """
    return listed_names(list_items(spark, path))


def inventory_problems(items: DataFrame) -> DataFrame:
    """``file, value, reason`` of files that are no list, and of the rest of lists that are cut."""
    reason = F.when(~F.col("listed"), "not a list").otherwise("cut list")
    return items.filter(~F.col("listed") | F.col("broken")).select("file", "value", reason.alias("reason"))


def inventory_names(pages: DataFrame, value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Pages of a listing, each an array document in a row -> ``bucket_name`` with its list
    position ``pos``. For files, which may be large, use ``read_inventory``.

    Elements are strings, or objects with ``bucket``, else ``name``; other elements,
    empty names and documents that are not arrays give nothing. ``keep`` names columns of
    ``pages`` to carry along (a page number, for example).
    """
    array = F.when(F.ltrim(value).startswith("["), F.try_parse_json(value))
    as_list = F.try_variant_get(array, "$", "array<variant>")
    rows = pages.select(*(keep or []), F.posexplode(as_list).alias("pos", "item"))
    return rows.select(*(keep or []), "pos", _name("item").alias("bucket_name")).filter(
        F.col("bucket_name").isNotNull()
    )
