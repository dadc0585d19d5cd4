"""Time predicates. ``as_of`` is always an explicit naive UTC datetime."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITION_DATE = "collected_date"


def ntz(moment: datetime) -> Column:
    """A naive timestamp literal; Spark folds it, so it reaches the Parquet scan."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_ntz(instant: Column) -> Column:
    """A zoned timestamp as naive UTC, whatever the session zone is."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), ntz(datetime(1970, 1, 1)))


def day_of(ts: Column) -> Column:
    """Start of the day of a naive timestamp (stays naive, no zone involved)."""
    return ts.cast("date").cast("timestamp_ntz")


def since(
    df: DataFrame,
    start: datetime,
    end: datetime | None = None,
    ts: str = "collected_at",
) -> DataFrame:
    """Rows with ``start <= ts <= end``.

    Catalyst does not derive a partition predicate from the timestamp, so when the
    table is partitioned by day the matching date predicate is added here.
    """
    keep = F.col(ts) >= ntz(start)
    if end is not None:
        keep &= F.col(ts) <= ntz(end)
    if PARTITION_DATE in df.columns:
        keep &= F.col(PARTITION_DATE) >= F.lit(start.date())
        if end is not None:
            keep &= F.col(PARTITION_DATE) <= F.lit(end.date())
    return df.filter(keep)


def age_seconds(ts: Column, as_of: datetime) -> Column:
    return F.timestamp_diff("MICROSECOND", ts, ntz(as_of)) / F.lit(1e6)


def is_stale(ts: Column, as_of: datetime, threshold: timedelta) -> Column:
    """Older than the threshold, or never collected."""
    return ts.isNull() | (ts < ntz(as_of - threshold))


def iso_text(ts: Column, separator: str = "T") -> Column:
    """ISO-8601 text; the fraction is left out when it is zero."""
    seconds = F.date_format(ts, f"yyyy-MM-dd'{separator}'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
