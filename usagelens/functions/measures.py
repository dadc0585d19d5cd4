"""Sums, guarded ratios and ordered first/last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIGINT = "bigint"
WIDE = "decimal(38,0)"


def total(name: str, dtype: str = BIGINT) -> Column:
    """Sum of a bigint column, 0 over no rows.

    ``bigint`` raises on overflow (ANSI). ``decimal(38,0)`` is exact past 2^63: the
    values are split at bit 20 and both halves summed as longs, so the hot loop
    stays in long arithmetic and only the final step is a decimal.
    """
    if dtype == BIGINT:
        return F.coalesce(F.sum(F.col(name).cast(BIGINT)), F.lit(0).cast(BIGINT))
    value = F.col(name).cast(BIGINT)
    high = F.sum(F.shiftright(value, 20)).cast("decimal(28,0)")
    low = F.sum(value.bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)")
    whole = high * F.lit(1 << 20).cast("decimal(9,0)") + low
    return F.coalesce(whole.cast(WIDE), F.lit(0).cast(WIDE))


def pct_change(new: Column, old: Column) -> Column:
    """Percent change; 0 when there was nothing before."""
    return F.when(old > 0, (new - old) * F.lit(100.0) / old).otherwise(F.lit(0.0))


def share_pct(part: Column, whole: Column) -> Column:
    """Percentage of a whole; an empty whole counts as 1."""
    return part * F.lit(100.0) / F.greatest(whole, F.lit(1))


def falsy(value: Column, default: Column | str) -> Column:
    """``default`` where the text is NULL or empty."""
    default = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.nullif(value, F.lit("")), default)
