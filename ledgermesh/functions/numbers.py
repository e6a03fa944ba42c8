"""Number, statistics and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed


def pct(part: Column, total: Column) -> Column:
    """Percentage rounded to six places; 0.0 when the total is zero."""
    share = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100.0
    return F.coalesce(F.round(share, 6), F.lit(0.0))


def percentile_of_counts(value: Column, q: float, frequency: Column) -> Column:
    """Linear-interpolated percentile over a (value, frequency) histogram."""
    return F.coalesce(F.round(F.percentile(value, q, frequency), 6), F.lit(0.0))


def pair_count(degree: Column) -> Column:
    """Unordered pairs among ``degree`` items, as a whole number."""
    wide = degree.cast("long")
    return F.shiftright(wide * (wide - 1), 1)


def cost_usd(input_tokens: Column, output_tokens: Column) -> Column:
    return (
        input_tokens * F.lit(fixed.INPUT_COST_PER_MILLION) / F.lit(1_000_000.0)
        + output_tokens * F.lit(fixed.OUTPUT_COST_PER_MILLION) / F.lit(1_000_000.0)
    )


def iso_date(c: Column) -> Column:
    """Date of an ISO text, null when it is not one."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def bar_date(stamp: Column) -> Column:
    """Session date of a bar: the first ten characters of its time stamp."""
    return iso_date(F.substring(stamp, 1, 10))


def window_start(mode: Column, end: Column) -> Column:
    """First day to fetch: long for a backfill or dry run, short otherwise."""
    days = F.when(mode.isin("backfill", "dry_run"), fixed.BACKFILL_DAYS).otherwise(fixed.INCREMENTAL_DAYS)
    return F.date_sub(end, days)
