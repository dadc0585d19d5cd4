"""Growth over time, ordered first/last, and the linear forecast."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelens.functions.measures import WIDE, total
from usagelens.functions.times import day_of, since
from usagelens.operators.maintenance import latest_per_key

# Message of a forecast without enough days, and days per month.
TOO_FEW_DAYS = "Insufficient data for forecast"
MONTH_DAYS = 30

SNAPSHOTS = "snapshots"
END_OF_DAY = "eod"


def _with_owner(per_entity: DataFrame, cur: DataFrame) -> DataFrame:
    """Join an aggregate of one row per entity with the owner; unique keys on both sides."""
    return per_entity.join(cur.select("bucket_name", "owner"), "bucket_name")


def _daily_basis(hist: DataFrame, basis: str, extra: list[str]) -> DataFrame:
    """Rows that count towards a day: every snapshot, or the last one of each entity."""
    day = day_of(F.col("collected_at")).alias("day")
    if basis == SNAPSHOTS:
        return hist.select(day, *extra, "size_bytes", "num_objects")
    order = ["collected_at"] + (["id"] if "id" in hist.columns else [])
    rows = hist.select(
        day, "bucket_name", *[c for c in extra if c != "bucket_name"], "size_bytes", "num_objects", *order
    )
    return latest_per_key(rows, ["day", "bucket_name"], order)


def cluster_growth(
    hist: DataFrame,
    as_of: datetime,
    days: int = 30,
    basis: str = SNAPSHOTS,
    total_type: str = WIDE,
) -> DataFrame:
    """Totals per day, exact past 2^63 unless ``total_type`` is a bigint. ``snapshots`` adds up every snapshot of a day, so it grows with the
    polling frequency; ``eod`` counts each entity once, with its last row of the day.
    """
    rows = _daily_basis(since(hist, as_of - timedelta(days=days)), basis, [])
    return (
        rows.groupBy("day")
        .agg(
            total("size_bytes", total_type).alias("total_size"),
            total("num_objects", total_type).alias("total_objects"),
        )
        .orderBy("day")
    )


def fastest_growing_entities(
    hist: DataFrame, cur: DataFrame, as_of: datetime, days: int = 7, limit: int = 20
) -> DataFrame:
    """Largest spread between smallest and largest size; at least two snapshots needed."""
    sizes = (
        since(hist, as_of - timedelta(days=days))
        .groupBy("bucket_name")
        .agg(
            F.min("size_bytes").alias("start_size"),
            F.max("size_bytes").alias("end_size"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n >= 2")
    )
    growth = (F.col("end_size") - F.col("start_size")).alias("growth_bytes")
    return (
        _with_owner(sizes, cur)
        .select("bucket_name", "owner", "start_size", "end_size", growth)
        .orderBy(F.desc("growth_bytes"), "bucket_name")
        .limit(limit)
    )


def fastest_growing_owners(
    hist: DataFrame,
    cur: DataFrame,
    as_of: datetime,
    days: int = 7,
    limit: int = 20,
    total_type: str = WIDE,
) -> DataFrame:
    """Spread of the daily owner totals, exact past 2^63 unless ``total_type`` is a bigint.

    Sizes are summed per (entity, day) before the join: the sums are the same and the
    join sees at most one row per entity and day, however often an entity was polled.
    """
    per_entity = (
        since(hist, as_of - timedelta(days=days))
        .groupBy("bucket_name", day_of(F.col("collected_at")).alias("day"))
        .agg(total("size_bytes", total_type).alias("size"))
    )
    daily = (
        _with_owner(per_entity, cur).groupBy("owner", "day").agg(F.sum("size").cast(total_type).alias("size"))
    )
    spread = daily.groupBy("owner").agg(
        F.min("size").alias("start_size"), F.max("size").alias("end_size")
    )
    growth = (F.col("end_size") - F.col("start_size")).cast(total_type).alias("growth_bytes")
    return (
        spread.select("owner", "start_size", "end_size", growth)
        .orderBy(F.desc("growth_bytes"), "owner")
        .limit(limit)
    )


def first_last_per_entity(
    hist: DataFrame, measures: list[str], ends: tuple[str, ...] = ("first", "last")
) -> DataFrame:
    """First and last values of an entity by time; equal times are ordered by ``id``.

    NULL values count. Without an ``id`` the times must be unique per entity; then every
    aggregate works on plain values and runs as a hash aggregate. With an ``id`` the rank is
    a struct and Spark sorts each task's rows by entity first. Both reduce before the shuffle.
    """
    pick = {"first": F.min_by, "last": F.max_by}
    if "id" not in hist.columns:
        edge = {"first": F.min, "last": F.max}
        return hist.groupBy("bucket_name").agg(
            *[
                column
                for end in ends
                for column in [
                    edge[end]("collected_at").alias(f"{end}_collected_at"),
                    *[pick[end](m, "collected_at").alias(f"{end}_{m}") for m in measures],
                ]
            ],
            F.count(F.lit(1)).alias("snapshots"),
        )
    values, rank = F.struct("collected_at", *measures), F.struct("collected_at", "id")
    ended = hist.groupBy("bucket_name").agg(
        *[pick[end](values, rank).alias(end) for end in ends],
        F.count(F.lit(1)).alias("snapshots"),
    )
    fields = [
        F.col(f"{end}.{name}").alias(f"{end}_{name}")
        for end in ends
        for name in ["collected_at", *measures]
    ]
    return ended.select("bucket_name", *fields, "snapshots")


def capacity_forecast(
    hist: DataFrame,
    as_of: datetime,
    history_days: int = 30,
    forecast_days: int = 90,
    by: list[str] | None = None,
    basis: str = SNAPSHOTS,
    total_type: str = WIDE,
) -> DataFrame:
    """Least-squares line through the daily totals, extended by ``forecast_days``.

    The x values are the positions of the days that have data (gaps collapse). Fewer than
    two days give a row with ``error``. With ``by`` there is one forecast per group.
    """
    by = by or []
    rows = _daily_basis(since(hist, as_of - timedelta(days=history_days)), basis, by)
    daily = rows.groupBy(*by, "day").agg(total("size_bytes", WIDE).alias("y"))
    # at most history_days + 1 rows per group from here on
    order = Window.partitionBy(*by).orderBy("day")
    indexed = daily.withColumn("x", (F.row_number().over(order) - 1).cast("bigint"))

    def whole(value: Column) -> Column:
        return F.sum(value).cast(WIDE)

    x, y = F.col("x"), F.col("y")
    sums = indexed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(x).alias("sx"),
        F.sum(x * x).alias("sxx"),
        whole(y).alias("sy"),
        whole((x.cast("decimal(10,0)") * y).cast(WIDE)).alias("sxy"),
        F.max_by(y, x).alias("last"),
    )
    # exact whole-number sums; one division at the end
    n = F.col("n").cast("decimal(10,0)")
    rise = (n * F.col("sxy")).cast(WIDE) - (F.col("sx").cast("decimal(10,0)") * F.col("sy")).cast(WIDE)
    run = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(F.col("n") >= 2, rise.cast("double") / F.nullif(run, F.lit(0)))
    known = F.when(F.col("n") >= 2, F.col("last").cast(total_type))
    ahead = F.col("current_bytes") + F.col("daily_growth_bytes") * F.lit(forecast_days)
    return sums.select(
        *by,
        known.alias("current_bytes"),
        slope.alias("daily_growth_bytes"),
        F.col("n").alias("data_points"),
    ).select(
        *by,
        "current_bytes",
        F.when(ahead.isNotNull(), F.greatest(ahead, F.lit(0.0))).alias("forecast_bytes"),
        F.lit(forecast_days).alias("forecast_days"),
        "daily_growth_bytes",
        (F.col("daily_growth_bytes") * MONTH_DAYS).alias("monthly_growth_bytes"),
        "data_points",
        F.when(F.col("data_points") < 2, TOO_FEW_DAYS).alias("error"),
    )
