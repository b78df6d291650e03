"""Codes to labels and numbers to text; the last step before display."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_codes(code: Column, labels: Mapping[int, str]) -> Column:
    """Name of a small integer code; null for an unknown code."""
    if not labels:
        return F.lit(None).cast("string")
    # A map refers to the code once; a CASE would repeat the expression behind it.
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), code)


def format_value(
    value: Column, decimals: int = 2, thousands: bool = True, percentage: bool = False
) -> Column:
    """Fixed decimals, optional thousands separator and percent sign."""
    x = value.cast("double")
    # One rounding rule, with and without separators: halves go to the even digit.
    text = F.format_number(x, decimals)
    if not thousands:
        text = F.replace(text, F.lit(","), F.lit(""))
    if percentage:
        text = F.concat(text, F.lit("%"))
    infinite = F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    if percentage:
        infinite = F.concat(infinite, F.lit("%"))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None).cast("string"))
        .when(F.abs(x) == float("inf"), infinite)
        .otherwise(text)
    )


def percentile_label(fraction: Column) -> Column:
    """0.25 -> ``25.0%``"""
    return F.concat((F.round(fraction * 100, 6)).cast("string"), F.lit("%"))


def quantile_label(fraction: Column) -> Column:
    """0.25 -> ``25th Percentile``"""
    whole = F.replace(F.format_number(fraction * 100, 0), F.lit(","), F.lit(""))
    return F.concat(whole, F.lit("th Percentile"))


def strength_label(iv: Column) -> Column:
    """Conventional reading of an Information Value."""
    return (
        F.when(iv < 0.02, "useless")
        .when(iv < 0.1, "weak")
        .when(iv < 0.3, "medium")
        .otherwise("strong")
    )
