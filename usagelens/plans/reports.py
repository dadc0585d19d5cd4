"""Query results as viewers show them: labels added as columns, no terminal output."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelens.functions.labels import (
    delta_label,
    human_age,
    human_bytes,
    human_rate,
    pct_label,
    severity,
    sync_label,
)
from usagelens.functions.measures import share_pct
from usagelens.functions.times import age_seconds
from usagelens.operators.compare import entity_comparison
from usagelens.operators.growth import capacity_forecast, fastest_growing_entities
from usagelens.operators.listing import listing, stale_report, top_by_size
from usagelens.operators.replication import sync_comparison
from usagelens.operators.summary import collection_freshness


def _short(name: str, width: int):
    return F.substring(F.coalesce(F.col(name), F.lit("")), 1, width).alias(name)


def listing_report(
    cur: DataFrame, as_of: datetime, sort_by: str = "age", limit: int = 50
) -> DataFrame:
    """The listing with size, sync, age and severity labels."""
    age = F.coalesce("age_seconds", F.lit(0.0))
    return listing(cur, as_of, sort_by, limit).select(
        _short("bucket_name", 40),
        _short("owner", 15),
        "num_objects",
        human_bytes(F.col("size_bytes")).alias("size"),
        sync_label(F.col("sync_status"), F.col("shards_behind")).alias("sync"),
        human_age(age).alias("age"),
        severity(age).alias("severity"),
    )


def top_report(cur: DataFrame, as_of: datetime, limit: int = 20) -> DataFrame:
    """Largest entities with size and age labels."""
    age = F.coalesce(age_seconds(F.col("collected_at"), as_of), F.lit(0.0))
    return top_by_size(cur, limit).select(
        _short("bucket_name", 40),
        _short("owner", 20),
        "num_objects",
        human_bytes(F.col("size_bytes")).alias("size"),
        human_age(age).alias("age"),
    )


def comparison_report(
    cur: DataFrame, hist: DataFrame, as_of: datetime, days: int = 7, limit: int = 30
) -> DataFrame:
    """The comparison with signed labels."""
    return entity_comparison(cur, hist, as_of, days, limit).select(
        _short("bucket_name", 35),
        _short("owner", 15),
        human_bytes(F.col("current_size")).alias("current"),
        human_bytes(F.col("old_size")).alias("past"),
        delta_label(F.col("size_delta")).alias("delta"),
        pct_label(F.col("size_pct_change"), F.col("size_delta")).alias("change"),
    )


def sync_report(cur: DataFrame, hist: DataFrame, as_of: datetime, limit: int = 30) -> DataFrame:
    """The first ``limit`` lagging rows of the sync comparison."""
    lagging = (F.col("sync_behind_shards") > 0) | (F.col("sync_behind_entries") > 0)
    return (
        sync_comparison(cur.filter(lagging), hist, as_of, limit)
        .select(
            _short("bucket_name", 35),
            _short("owner", 15),
            "sync_status",
            "shards_behind",
            "entries_behind",
            "avg_shards_24h",
        )
    )


def growth_report(
    hist: DataFrame, cur: DataFrame, as_of: datetime, days: int = 7, limit: int = 20
) -> DataFrame:
    """Fastest growing entities with size labels."""
    return fastest_growing_entities(hist, cur, as_of, days, limit).select(
        _short("bucket_name", 35),
        _short("owner", 15),
        human_bytes(F.col("start_size")).alias("start"),
        human_bytes(F.col("end_size")).alias("end"),
        delta_label(F.col("growth_bytes")).alias("growth"),
    )


def forecast_report(
    hist: DataFrame, as_of: datetime, history_days: int = 7, forecast_days: int = 90
) -> DataFrame:
    """The forecast with size labels."""

    names = ["daily_growth_bytes", "monthly_growth_bytes", "forecast_bytes"]
    return capacity_forecast(hist, as_of, history_days, forecast_days).select(
        human_bytes(F.col("current_bytes")).alias("current"),
        *[human_rate(F.col(n)).alias(n.removesuffix("_bytes")) for n in names],
        "error",
    )


def freshness_report(cur: DataFrame, as_of: datetime) -> DataFrame:
    """Freshness counts with the rest counted as stale."""
    stale = F.col("total") - F.col("fresh_1h")
    return collection_freshness(cur, as_of).select(
        "total",
        "fresh_5m",
        "fresh_10m",
        "fresh_1h",
        stale.alias("stale"),
        share_pct(stale, F.col("total")).alias("stale_pct"),
    )


def oldest_report(
    cur: DataFrame, as_of: datetime, minutes: int = 5, limit: int = 10
) -> DataFrame:
    """The oldest rows with their age, as the live view lists them."""
    return stale_report(cur, as_of, minutes, limit).select(
        "bucket_name", human_age(age_seconds(F.col("collected_at"), as_of)).alias("age")
    )
