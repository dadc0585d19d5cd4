"""Display labels (bytes, age, severity, signed changes, sync)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, 1024 apart.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]

# Age limits of the severity colours, in seconds.
RED_AFTER = 3600
YELLOW_AFTER = 600


def _in_unit(magnitude: Column, step: int) -> Column:
    """``magnitude / 1024^step`` with one decimal, rounded half to even.

    Whole-number arithmetic: the label does not depend on how an engine formats
    binary fractions.
    """
    bits = 10 * step
    mask = F.lit((1 << bits) - 1).cast("bigint")
    rest = magnitude.bitwiseAND(mask) * F.lit(10)
    tenths = F.shiftright(magnitude, bits) * F.lit(10) + F.shiftright(rest, bits)
    twice = rest.bitwiseAND(mask) * F.lit(2)
    one = F.lit(1 << bits).cast("bigint")
    up = (twice > one) | ((twice == one) & (tenths % 2 == 1))
    tenths = tenths + F.when(up, 1).otherwise(0)
    whole = F.floor(tenths / F.lit(10)).cast("string")
    return F.concat(whole, F.lit("."), (tenths % 10).cast("string"), F.lit(f" {UNITS[step]}"))


def human_bytes(size: Column, zero: str = "0 B") -> Column:
    """``1536 -> 1.5 KB``. The sign is kept; sizes past the last unit stay in it. Sizes past
    2^63 are labelled as fractional ones."""
    given, size = size, size.try_cast("bigint")
    magnitude = F.abs(size)
    label = F.when(magnitude < 1024, _in_unit(magnitude, 0))
    for step in range(1, len(UNITS) - 1):
        label = label.when(magnitude < (1 << 10 * (step + 1)), _in_unit(magnitude, step))
    label = label.otherwise(_in_unit(magnitude, len(UNITS) - 1))
    signed = F.concat(F.when(size < 0, "-").otherwise(""), label)
    known = F.when(size.isNull() | (size == 0), F.lit(zero)).otherwise(signed)
    return F.when(size.isNull() & given.isNotNull(), human_rate(given)).otherwise(known)


def human_rate(size: Column, zero: str = "0 B") -> Column:
    """The same for fractional sizes, such as a growth per day."""
    size = size.cast("double")
    magnitude = F.abs(size)

    def in_unit(step: int) -> Column:
        scaled = F.bround(size / F.lit(float(1 << 10 * step)), 1)
        return F.format_string(f"%.1f {UNITS[step]}", scaled)

    label = F.when(size.isNull() | (size == 0), F.lit(zero))
    for step in range(len(UNITS) - 1):
        label = label.when(magnitude < float(1 << 10 * (step + 1)), in_unit(step))
    return label.otherwise(in_unit(len(UNITS) - 1))


def human_age(seconds: Column) -> Column:
    """``90 -> 1m``; truncating; NULL gives ``N/A``."""

    def whole(unit: int, suffix: str) -> Column:
        # cast to bigint truncates toward zero
        return F.concat((seconds / F.lit(float(unit))).cast("bigint").cast("string"), F.lit(suffix))

    return (
        F.when(seconds.isNull(), F.lit("N/A"))
        .when(seconds < 60, whole(1, "s"))
        .when(seconds < 3600, whole(60, "m"))
        .when(seconds < 86400, whole(3600, "h"))
        .otherwise(whole(86400, "d"))
    )


def severity(seconds: Column) -> Column:
    return (
        F.when(seconds > RED_AFTER, "red").when(seconds > YELLOW_AFTER, "yellow").otherwise("green")
    )


def pct_label(pct: Column, delta: Column) -> Column:
    """Percent with one decimal and the sign of ``delta``; ``0%`` without a change."""
    text = F.format_string("%.1f%%", F.bround(pct, 1))
    return F.when(delta > 0, F.concat(F.lit("+"), text)).when(delta < 0, text).otherwise("0%")


def delta_label(delta: Column) -> Column:
    """Signed human-readable byte difference."""
    return F.concat(F.when(delta > 0, "+").otherwise(""), human_bytes(delta))


def sync_label(status: Column, shards: Column) -> Column:
    """Status, ``-`` when unknown, with the lag in shards when there is one."""
    name = F.coalesce(F.nullif(status, F.lit("")), F.lit("-"))
    lag = F.concat(F.lit(" ("), shards.cast("string"), F.lit(")"))
    return F.concat(name, F.when(shards > 0, lag).otherwise(""))
