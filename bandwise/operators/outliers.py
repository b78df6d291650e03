"""Outlier rules: compare a value with a fixed or percentile threshold, sparing the mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.predicates import COMPARISONS
from bandwise.operators.ordering import sketch_columns
from bandwise.operators.quantiles import (
    MAP_LIMIT,
    Ask,
    counted_quantiles,
    most_frequent,
    value_counts,
)

# The percentiles a rule may use.
PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99)


@dataclass(frozen=True)
class OutlierRule:
    """``column comparison threshold``, never for the most frequent value or null."""

    column: str
    comparison: str
    threshold: float
    mode: float | None = None

    def is_outlier(self) -> Column:
        c = F.col(self.column)
        hit = COMPARISONS[self.comparison](c, F.lit(self.threshold)) & c.isNotNull()
        return hit if self.mode is None else hit & (c != F.lit(self.mode))

    def keeps(self) -> Column:
        """True for rows to keep. Null values are kept."""
        return ~self.is_outlier()


def mode_value(df: DataFrame, column: str) -> float | None:
    """Most frequent non-null value of the whole column; the smallest on ties."""
    return most_frequent(df, column).first()["mode"]


def non_mode_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    limit: int = MAP_LIMIT,
) -> dict[str, tuple[float | None, list[float | None]]]:
    """Per column: its mode, and linear quantiles of its values other than the mode.

    Both come from one count of distinct values for all columns; one more pass
    takes the sketches.
    """
    columns = list(dict.fromkeys(columns))
    values = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    sketches = sketch_columns(values, columns)
    counts = value_counts(values, [], [F.col(c) for c in columns])
    # One row per column.
    modes = counts.groupBy("variable").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode")
    )
    found = {columns[row["variable"]]: (row["mode"], []) for row in modes.collect()}
    is_mode = F.lit(False)
    for i, c in enumerate(columns):
        if c in found:
            is_mode = is_mode | ((F.col("variable") == i) & (F.col("value") == found[c][0]))
    asks = [Ask(q) for q in fractions]
    known = [sketches[c] for c in columns]
    quantiles: dict[str, list[float | None]] = {}
    if asks:
        for row in counted_quantiles(counts.filter(~is_mode), asks, known, limit).collect():
            quantiles[columns[row["variable"]]] = list(row["quantiles"])
    nothing: list[float | None] = [None] * len(fractions)
    return {
        c: (found[c][0] if c in found else None, quantiles.get(c, list(nothing))) for c in columns
    }


@dataclass(frozen=True)
class OutlierSpec:
    """A rule before its threshold is known: a percentile or a fixed value."""

    column: str
    comparison: str
    percentile: int | None = None
    value: float | None = None

    def __post_init__(self):
        if self.comparison not in (">", ">=", "<", "<="):
            raise ValueError(f"unknown comparison {self.comparison!r}")
        if (self.percentile is None) == (self.value is None):
            raise ValueError("give either a percentile or a value")
        if self.percentile is not None and self.percentile not in PERCENTILES:
            raise ValueError(f"percentile must be one of {PERCENTILES}")


def outlier_rules(
    df: DataFrame, specs: Sequence[OutlierSpec], limit: int = MAP_LIMIT
) -> list[OutlierRule]:
    """Rules with their modes and thresholds, from all rows of the table.

    However many rules there are, they share two passes.
    """
    fractions = sorted({s.percentile / 100 for s in specs if s.percentile is not None})
    known = non_mode_quantiles(df, [s.column for s in specs], fractions, limit)
    rules = []
    for s in specs:
        mode, quantiles = known[s.column]
        if s.percentile is None:
            threshold = float(s.value)
        else:
            threshold = quantiles[fractions.index(s.percentile / 100)]
        rules.append(
            OutlierRule(s.column, s.comparison, 0.0 if threshold is None else threshold, mode)
        )
    return rules


def outlier_rule(
    df: DataFrame,
    column: str,
    comparison: str,
    percentile: int | None = None,
    value: float | None = None,
    limit: int = MAP_LIMIT,
) -> OutlierRule:
    """One rule with its mode and threshold."""
    return outlier_rules(df, [OutlierSpec(column, comparison, percentile, value)], limit)[0]


def outlier_counts(df: DataFrame, rules: Sequence[OutlierRule]) -> DataFrame:
    """Outliers per rule, and rows hit by any rule, from one pass."""
    names = [f"{r.column} {r.comparison} {r.threshold}" for r in rules]
    any_hit = F.lit(False)
    for r in rules:
        any_hit = any_hit | r.is_outlier()
    counted = df.agg(
        *(F.count_if(r.is_outlier()).alias(f"n{i}") for i, r in enumerate(rules)),
        F.count_if(any_hit).alias("n_any"),
    )
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col(f"n{i}").alias("outliers"))
        for i, name in enumerate(names)
    ]
    entries.append(F.struct(F.lit("any rule").alias("rule"), F.col("n_any").alias("outliers")))
    return counted.select(F.inline(F.array(*entries)))
