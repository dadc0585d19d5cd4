"""Replace-by-key merge, schema evolution, repair."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from usagelens.functions.times import ntz


def latest_per_key(
    df: DataFrame, keys: list[str], order: list[str], carry: list[str] | None = None
) -> DataFrame:
    """The last row per key by ``order``.

    ``carry`` columns belong together. They come from the last row in which the first of them
    is not NULL, so a row that does not know them keeps what an earlier row said, and never a
    mixture of two rows. From then on they count as said by the row that kept them.

    Plain aggregates: rows of one key are reduced before the shuffle, and no key's rows are
    ever gathered in one task, however many it has.
    """
    carry = carry or []
    rest = [c for c in df.columns if c not in keys and c not in carry]
    rank = F.struct(*order)
    kept = [F.max_by(F.struct(*rest), rank).alias("_row")]
    if carry:
        # the rank is NULL in rows that do not know them, and a NULL rank never wins
        known = F.when(F.col(carry[0]).isNotNull(), rank)
        kept.append(F.max_by(F.struct(*carry), known).alias("_carried"))
    merged = df.groupBy(*keys).agg(*kept)
    places = dict.fromkeys(rest, "_row.") | dict.fromkeys(carry, "_carried.")
    return merged.select(*[F.col(places.get(c, "") + c) for c in df.columns])


def merge_latest(
    base: DataFrame,
    updates: DataFrame,
    keys: list[str],
    order: list[str],
    carry: list[str] | None = None,
) -> DataFrame:
    """Replace rows of ``base`` by newer ``updates``. Repeating a merge changes nothing."""
    return latest_per_key(base.unionByName(updates), keys, order, carry)


def conform(
    df: DataFrame, schema: T.StructType, fill_nulls: tuple[str, ...] = ()
) -> DataFrame:
    """Columns of ``schema`` in order; a missing one is added with its typed default.

    ``fill_nulls`` names columns in which NULL also means missing: a Parquet read with an
    explicit schema gives NULL for a column that older files lack.
    """

    def default(dtype: T.DataType) -> Column:
        if isinstance(dtype, T.StringType):
            return F.lit("")
        if isinstance(dtype, T.BooleanType):
            return F.lit(False)
        if isinstance(dtype, (T.IntegerType, T.LongType)):
            return F.lit(0)
        if isinstance(dtype, T.MapType):
            return F.create_map()
        return F.lit(None)

    def column(field: T.StructField) -> Column:
        fallback = default(field.dataType).cast(field.dataType)
        if field.name not in df.columns:
            return fallback.alias(field.name)
        value = F.col(field.name).cast(field.dataType)
        if field.name in fill_nulls:
            value = F.coalesce(value, fallback)
        return value.alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def repair_null_times(cur: DataFrame, as_of: datetime) -> DataFrame:
    """Give rows without a collection time the time ``as_of``."""
    return cur.withColumn("collected_at", F.coalesce("collected_at", ntz(as_of)))


def repair_dry_run(cur: DataFrame) -> DataFrame:
    """How many rows a repair would change."""
    return cur.agg(F.count_if(F.col("collected_at").isNull()).alias("null_collected_at"))
