"""Summaries across the columns of one row. Nulls are skipped."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandwise.functions.arithmetic import as_column


def _doubles(columns: Sequence[Column | str]) -> list[Column]:
    if not columns:
        raise ValueError("at least one column is needed")
    return [as_column(c).cast("double") for c in columns]


def _present(columns: Sequence[Column | str]) -> Column:
    return F.array_compact(F.array(*_doubles(columns)))


def row_sum(*columns: Column | str) -> Column:
    """Sum with null as zero; an all-null row gives 0."""
    total = F.lit(0.0)
    for c in _doubles(columns):
        total = total + F.coalesce(c, F.lit(0.0))
    return total


def row_mean(*columns: Column | str) -> Column:
    """Mean of the non-null values; null if there are none."""
    return F.try_divide(row_sum(*columns), F.size(_present(columns)))


def row_median(*columns: Column | str) -> Column:
    """Middle value, or the mean of the middle two."""
    values = F.array_sort(_present(columns))
    n = F.size(values)
    low = F.try_element_at(values, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(values, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def row_min(*columns: Column | str) -> Column:
    values = _doubles(columns)
    return F.least(*values) if len(values) > 1 else values[0]


def row_max(*columns: Column | str) -> Column:
    values = _doubles(columns)
    return F.greatest(*values) if len(values) > 1 else values[0]


def row_std(*columns: Column | str) -> Column:
    """Sample standard deviation; null for fewer than two values."""
    values = _present(columns)
    n = F.size(values)
    mean = row_mean(*columns)
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(squares / (n - 1)))
