"""The four tables, from Parquet folders or as views for free SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Table names used in free SQL.
VIEW_NAMES = {
    "cur": "bucket_stats",
    "hist": "bucket_stats_history",
    "usage": "storage_class_usage",
    "inv": "inventory",
}


@dataclass(frozen=True)
class Tables:
    """Latest rows, history, usage per class, and the inventory.

    ``keyed``: the usage table is known to have one row per (entity, class).
    """

    cur: DataFrame
    hist: DataFrame
    usage: DataFrame
    inv: DataFrame | None = None
    keyed: bool = False

    def register(self) -> None:
        """Temp views under their table names."""
        for field, view in VIEW_NAMES.items():
            frame = getattr(self, field)
            if frame is not None:
                frame.createOrReplaceTempView(view)


def custom_sql(spark: SparkSession, tables: Tables, sql: str, **args: object) -> DataFrame:
    """Free SQL over the tables; ``args`` are bound as named parameters.

    The table names hold for this statement only: it is analysed here, then views of the
    session that have the same names are as before.
    """
    before = {v: spark.table(v) for v in VIEW_NAMES.values() if _is_view(spark, v)}
    try:
        tables.register()
        return spark.sql(sql, args=args or None)
    finally:
        for view in VIEW_NAMES.values():
            if view in before:
                before[view].createOrReplaceTempView(view)
            else:
                spark.catalog.dropTempView(view)


def _is_view(spark: SparkSession, name: str) -> bool:
    return any(t.isTemporary and t.name == name for t in spark.catalog.listTables(pattern=name))
