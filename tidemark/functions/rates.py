"""Rates and status rules. A missing denominator gives null, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.defaults import MAX_FAILURE_RATE


def rate(count: Column, total: Column) -> Column:
    """``count / total``; null when the total is missing or zero."""
    return F.when(total > 0, count / total)


def change_pp(target_rate: Column, baseline_rate: Column) -> Column:
    return (target_rate - baseline_rate) * 100


# Splits a double into two halves whose products are exact.
_SPLIT = 2.0**27 + 1


def rounded(value: Column, digits: int) -> Column:
    """A double to so many decimals, by its exact binary value, ties to even.

    The product with the power of ten is taken with its error, so 0.35, which is a little less
    than its decimal form, becomes 0.3 and not 0.4.
    """
    scale = 10.0**digits
    high = scale * _SPLIT - (scale * _SPLIT - scale)
    low = scale - high
    x = value.cast("double")
    product = x * scale
    x_high = x * _SPLIT - (x * _SPLIT - x)
    x_low = x - x_high
    error = ((x_high * high - product) + x_high * low + x_low * high) + x_low * low
    floor = F.floor(product).cast("double")
    part = product - floor
    odd = floor % 2 != 0
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & odd)))
    near = (floor + F.when(up, 1.0).otherwise(0.0)) / scale
    # from 2^52 on a double has no decimals, and beyond the long range no floor
    return F.when(F.abs(product) < 2.0**52, near).otherwise(x)


def percent(count: Column, total: Column) -> Column:
    """Percentage with one decimal, by the exact binary value, ties to even."""
    return rounded(rate(count, total) * 100, 1)


def unprocessed(total: Column, succeeded: Column, failed: Column, in_progress: Column) -> Column:
    return F.greatest(total - succeeded - failed - in_progress, F.lit(0).cast("bigint"))


def period_status(
    total: Column,
    succeeded: Column,
    failed: Column,
    in_progress: Column,
    max_failure_rate: float = MAX_FAILURE_RATE,
) -> Column:
    """complete / partial_failure / in_progress / not_started for one period."""
    finished = (total > 0) & (succeeded + failed >= total) & (in_progress == 0)
    return (
        F.when(finished & (failed / total <= max_failure_rate), "complete")
        .when(finished, "partial_failure")
        .when((succeeded > 0) | (failed > 0) | (in_progress > 0), "in_progress")
        .otherwise("not_started")
    )


def combined_status(target: Column, baseline: Column, any_succeeded: Column) -> Column:
    """One status for two periods."""
    return (
        F.when((target == "partial_failure") | (baseline == "partial_failure"), "partial_failure")
        .when((target == "complete") & (baseline == "complete"), "complete")
        .when(any_succeeded | (target == "in_progress") | (baseline == "in_progress"), "in_progress")
        .otherwise("not_started")
    )
