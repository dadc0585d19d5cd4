"""Reading and writing the nested parts of a stats document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.schemas import CORRUPT, PLACEMENT_DEFAULT, QUOTA_DEFAULT, USAGE


# Measures as any number, and a place for the text of an object that has others.
_ANY_NUMBER = T.StructType(
    [
        *[T.StructField(name, T.DecimalType(38, 6)) for name in USAGE.names],
        T.StructField(CORRUPT, T.StringType()),
    ]
)


def usage_of_texts(texts: Column) -> Column:
    """``map<string,string>`` of JSON texts -> map of measures and ``_bad``. Values that are no
    objects are dropped.
    """
    objects = F.map_filter(texts, lambda _, text: F.ltrim(text).startswith("{"))
    options = {"columnNameOfCorruptRecord": CORRUPT}
    return F.transform_values(objects, lambda _, text: F.from_json(text, _ANY_NUMBER, options))


def whole_measures(usage: Column) -> Column:
    """Measures of any number type -> ``map<string,USAGE>``."""

    def rounded(_: Column, cls: Column) -> Column:
        return F.struct(*[F.round(cls[n], 0).cast("bigint").alias(n) for n in USAGE.names])

    return F.transform_values(usage, rounded)


def usage_total(usage: Column, measure: str) -> Column:
    """Sum of one measure over the classes of one document; missing counts as 0."""
    return F.aggregate(
        F.map_values(usage),
        F.lit(0).cast("bigint"),
        lambda acc, cls: acc + F.coalesce(cls[measure], F.lit(0).cast("bigint")),
    )


def usage_document(usage: Column) -> Column:
    """The usage map for export: measures a document never had stay absent."""

    def measures(_: Column, cls: Column) -> Column:
        pairs = [part for name in USAGE.names for part in (F.lit(name), cls[name])]
        return F.map_filter(F.create_map(*pairs), lambda __, value: value.isNotNull())

    empty = F.create_map().cast(T.MapType(T.StringType(), T.MapType(T.StringType(), T.LongType())))
    return F.coalesce(F.transform_values(usage, measures), empty)


def _struct_default(struct: Column, defaults: dict) -> Column:
    """The struct, or the default where it is NULL or every field of it is NULL."""
    filled = F.coalesce(*[struct[name].cast("string") for name in defaults]).isNotNull()
    fallback = F.struct(*[_literal(value).alias(name) for name, value in defaults.items()])
    return F.when(filled, struct).otherwise(fallback)


def _literal(value: object) -> Column:
    literal = F.lit(value)
    return literal.cast("bigint") if type(value) is int else literal


def placement_document(placement: Column) -> Column:
    return _struct_default(placement, PLACEMENT_DEFAULT)


def quota_document(quota: Column) -> Column:
    return _struct_default(quota, QUOTA_DEFAULT)
