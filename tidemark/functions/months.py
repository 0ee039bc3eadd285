"""Month keys.

Inside plans a month is an integer, ``year * 12 + month - 1``: it is cheap to group
on and adjacent months differ by one. ``YYYY-MM`` text is produced only for
output. Timestamps are read in the session zone, which must be UTC.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.defaults import END_YEAR, FIRST_YEAR

FIRST_INDEX = FIRST_YEAR * 12
END_INDEX = END_YEAR * 12


def month_index(ts: Column) -> Column:
    """Month index of a timestamp."""
    return F.year(ts) * 12 + F.month(ts) - 1


def index_of_key(key: Column) -> Column:
    """Month index of ``YYYY-MM`` text; null when the text is not a month."""
    valid = key.rlike(r"^\d{4}-(0[1-9]|1[0-2])$")
    year = F.substring(key, 1, 4).try_cast("int")
    month = F.substring(key, 6, 2).try_cast("int")
    return F.when(valid, year * 12 + month - 1)


def key_of_index(index: Column) -> Column:
    """``YYYY-MM`` text of a month index."""
    year = F.lpad(F.floor(index / 12).cast("string"), 4, "0")
    month = F.lpad((F.pmod(index, F.lit(12)) + 1).cast("string"), 2, "0")
    return F.concat_ws("-", year, month)


def month_key(ts: Column) -> Column:
    return key_of_index(month_index(ts))


def shift_month(key: Column, delta: int | Column) -> Column:
    """Calendar shift of ``YYYY-MM`` text."""
    return key_of_index(index_of_key(key) + delta)


def parse_month(value: str) -> int:
    """Month index of a ``YYYY-MM`` argument."""
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", value):
        raise ValueError(f"not a month: {value!r}")
    year, month = value.split("-")
    return int(year) * 12 + int(month) - 1


def month_start(index: int) -> str:
    return f"{index // 12:04d}-{index % 12 + 1:02d}-01 00:00:00"


def in_month(ts: Column, month: str) -> Column:
    """Half-open period test that the Parquet scan can use for pruning."""
    index = parse_month(month)
    lower = F.to_timestamp(F.lit(month_start(index)))
    upper = F.to_timestamp(F.lit(month_start(index + 1)))
    return (ts >= lower) & (ts < upper)


def in_months(ts: Column, months: list[str]) -> Column:
    """Any of several months; runs of adjacent months become one range."""
    if not months:
        raise ValueError("at least one month is needed")
    indexes = sorted({parse_month(m) for m in months})
    runs: list[list[int]] = []
    for index in indexes:
        if runs and index == runs[-1][1]:
            runs[-1][1] = index + 1
        else:
            runs.append([index, index + 1])
    test = F.lit(False)
    for first, end in runs:
        lower = F.to_timestamp(F.lit(month_start(first)))
        upper = F.to_timestamp(F.lit(month_start(end)))
        test = test | ((ts >= lower) & (ts < upper))
    return test


def in_supported_range(index: Column) -> Column:
    return (index >= FIRST_INDEX) & (index < END_INDEX)


def timestamp_from_millis(millis: Column) -> Column:
    """UTC timestamp; null outside the supported range."""
    return F.when(millis_in_range(millis), F.timestamp_millis(millis))


# 1990-01-01 and 2101-01-01 as epoch milliseconds.
FIRST_MILLIS = 631_152_000_000
END_MILLIS = 4_133_980_800_000


def millis_in_range(millis: Column) -> Column:
    return F.coalesce((millis >= FIRST_MILLIS) & (millis < END_MILLIS), F.lit(False))
