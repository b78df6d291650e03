"""Metrics: named scalar summaries of rows, evaluated per group.

Kinds, by what a group has to remember:

* ``Additive``: a few sums, minima, maxima, products or sketches of distinct
  values. Partial results of small groups add up to those of larger ones, so
  totals, running totals and subtotals come from one pass over the data.
* ``Central``: central moments, which merge as well.
* ``Grouped``: any Spark aggregate. One pass, but every level of subtotals is
  aggregated from rows.
* ``Quantile``: needs the values of a group. All quantiles of a summary share
  one pass that counts distinct values; those counts add up like sums do.
* ``Holistic``: anything else. Runs as its own distributed plan and is joined
  back on the group keys; modes and autocorrelations serve all levels or running
  groups from one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.arithmetic import as_column, ratio
from bandwise.functions.labels import format_value
from bandwise.operators.moments import (
    Moments,
    correlation_of,
    kurtosis_of,
    skewness_of,
    variance_of,
)
from bandwise.operators.ordering import DISTINCT_LIMIT, ranged_rows
from bandwise.operators.quantiles import MAP_LIMIT, Ask, level_modes, most_frequent, rolled_up
from bandwise.operators.runs import VIEW, autocorrelations

TOTAL_SIZE = "total_size"


@dataclass(frozen=True)
class Metric:
    """What every metric has: a name, its sources and how it is displayed.

    ``sources`` None means every row; an empty tuple means no rows.
    """

    name: str
    sources: tuple[str, ...] | None = field(default=None, kw_only=True)
    cumulative: bool = field(default=False, kw_only=True)
    percentage: bool = field(default=False, kw_only=True)
    decimals: int = field(default=2, kw_only=True)
    thousands: bool = field(default=True, kw_only=True)

    def on(self, *sources: str) -> Metric:
        """The same metric over some sources only."""
        return replace(self, sources=tuple(sources))

    def running(self) -> Metric:
        """The same metric over all groups up to the current one."""
        return replace(self, cumulative=True)

    def shown(self, value: Column) -> Column:
        return format_value(value, self.decimals, self.thousands, self.percentage)

    def scaled(self, value: Column) -> Column:
        return value * 100 if self.percentage else value


@dataclass(frozen=True)
class Part:
    """A row value and how it is combined: sum, min, max, product, or hll.

    The last is a sketch of the distinct non-null values, which are integers.
    """

    value: Column
    merge: str = "sum"

    def start(self) -> Column:
        """The aggregate of rows."""
        return F.hll_sketch_agg(self.value) if self.merge == "hll" else self.combine(self.value)

    def combine(self, value: Column) -> Column:
        """The aggregate of what ``start`` made of smaller groups."""
        ways = {"sum": F.sum, "min": F.min, "max": F.max, "product": F.product, "hll": F.hll_union_agg}
        return ways[self.merge](value)


@dataclass(frozen=True)
class Additive(Metric):
    """``finish`` turns the combined parts into the metric value."""

    parts: Mapping[str, Part] = field(default_factory=dict)
    finish: Callable[[Mapping[str, Column]], Column] | None = None
    uses_total_size: bool = False


@dataclass(frozen=True)
class Central(Metric):
    """``finish`` turns the moments of one input, or the co-moments of two, into the value."""

    inputs: tuple[Column, ...] = ()
    finish: Callable[[Mapping[str, Column]], Column] | None = None
    power: int = 2

    def state(self, prefix: str) -> Moments:
        return Moments(prefix, self.power, pair=len(self.inputs) == 2)


@dataclass(frozen=True)
class Grouped(Metric):
    """``build`` makes a Spark aggregate from the row inputs.

    Inputs are kept apart from the aggregate so that rows of other sources can
    be blanked out; the aggregate has to ignore nulls, as Spark's own do.
    """

    inputs: tuple[Column, ...] = ()
    build: Callable[..., Column] | None = None


@dataclass(frozen=True)
class Quantile(Metric):
    """Exact quantile. ``limit`` bounds the distinct values handled by one task."""

    column: str = ""
    ask: Ask = Ask(0.5)
    limit: int = MAP_LIMIT


@dataclass(frozen=True)
class Holistic(Metric):
    """``plan(df, keys)`` returns one row per key with a column ``value``.

    ``at_levels(df, dims, levels)`` may make several levels from one pass
    (dimensions, ``LEVEL``, ``value``). ``running_plan(df, ordinal, count)`` may
    make the values over all rows up to each ordinal below ``count``.
    """

    plan: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None
    at_levels: Callable[[DataFrame, Sequence[str], Sequence[Sequence[str]]], DataFrame] | None = None
    running_plan: Callable[[DataFrame, str, int], DataFrame] | None = None


def _sum(p: Mapping[str, Column], name: str) -> Column:
    return F.coalesce(p[name], F.lit(0))


# --- additive -------------------------------------------------------------


def total(name: str, column: Column | str, **display: Any) -> Additive:
    """Sum; 0 over no rows or only nulls."""
    return Additive(
        name, parts={"s": Part(as_column(column))}, finish=lambda p: _sum(p, "s"), **display
    )


def row_count(name: str, **display: Any) -> Additive:
    """Number of rows, nulls included."""
    return Additive(
        name,
        parts={"n": Part(F.lit(1).cast("bigint"))},
        finish=lambda p: _sum(p, "n"),
        **{"decimals": 0, **display},
    )


def value_count(name: str, column: Column | str, **display: Any) -> Additive:
    """Number of non-null values."""
    return Additive(
        name,
        parts={"n": Part(as_column(column).isNotNull().cast("bigint"))},
        finish=lambda p: _sum(p, "n"),
        **{"decimals": 0, **display},
    )


def count_where(name: str, condition: Column, **display: Any) -> Additive:
    """Number of rows for which a condition is true."""
    hit = F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return Additive(
        name, parts={"n": Part(hit)}, finish=lambda p: _sum(p, "n"), **{"decimals": 0, **display}
    )


def mean(name: str, column: Column | str, **display: Any) -> Additive:
    c = as_column(column).cast("double")
    parts = {"s": Part(c), "n": Part(c.isNotNull().cast("bigint"))}
    return Additive(name, parts=parts, finish=lambda p: F.try_divide(p["s"], p["n"]), **display)


def smallest(name: str, column: Column | str, **display: Any) -> Additive:
    parts = {"m": Part(as_column(column), "min")}
    return Additive(name, parts=parts, finish=lambda p: p["m"], **display)


def largest(name: str, column: Column | str, **display: Any) -> Additive:
    parts = {"m": Part(as_column(column), "max")}
    return Additive(name, parts=parts, finish=lambda p: p["m"], **display)


def every(name: str, column: Column | str, **display: Any) -> Additive:
    """True unless some non-null value is false or zero."""
    parts = {"m": Part(as_column(column).cast("boolean").cast("int"), "min")}
    return Additive(
        name, parts=parts, finish=lambda p: F.coalesce(p["m"], F.lit(1)) == 1, **display
    )


def some(name: str, column: Column | str, **display: Any) -> Additive:
    """True if some non-null value is true or non-zero."""
    parts = {"m": Part(as_column(column).cast("boolean").cast("int"), "max")}
    return Additive(
        name, parts=parts, finish=lambda p: F.coalesce(p["m"], F.lit(0)) == 1, **display
    )


def quotient(
    name: str, numerator: Column | str, denominator: Column | str, factor: float = 1.0, **display: Any
) -> Additive:
    """Ratio of two sums times a constant, with IEEE division."""
    parts = {"n": Part(as_column(numerator)), "d": Part(as_column(denominator))}
    return Additive(
        name, parts=parts, finish=lambda p: ratio(_sum(p, "n"), _sum(p, "d")) * factor, **display
    )


def product(name: str, column: Column | str, **display: Any) -> Additive:
    """Product of the non-null values; 1 if there are none."""
    parts = {"p": Part(as_column(column).cast("double"), "product")}
    return Additive(name, parts=parts, finish=lambda p: F.coalesce(p["p"], F.lit(1.0)), **display)


# --- central --------------------------------------------------------------


def _central(
    name: str, finish: Callable[[Mapping[str, Column]], Column], *inputs: Column | str, **options: Any
) -> Central:
    return Central(name, inputs=tuple(as_column(c) for c in inputs), finish=finish, **options)


def std(name: str, column: Column | str, **display: Any) -> Central:
    return _central(name, lambda p: F.sqrt(variance_of(p)), column, **display)


def variance(name: str, column: Column | str, **display: Any) -> Central:
    return _central(name, variance_of, column, **display)


def skewness(name: str, column: Column | str, **display: Any) -> Central:
    """Population skewness."""
    return _central(name, skewness_of, column, power=3, **display)


def kurtosis(name: str, column: Column | str, **display: Any) -> Central:
    """Population excess kurtosis."""
    return _central(name, kurtosis_of, column, power=4, **display)


def standard_error(name: str, column: Column | str, **display: Any) -> Central:
    return _central(
        name, lambda p: F.sqrt(F.try_divide(variance_of(p), p["n"])), column, **display
    )


def covariance(name: str, a: Column | str, b: Column | str, **display: Any) -> Central:
    return _central(name, lambda p: variance_of(p, "xy"), a, b, **display)


def correlation(name: str, a: Column | str, b: Column | str, **display: Any) -> Central:
    """Null below two pairs and where one side is constant."""
    return _central(name, correlation_of, a, b, **display)


# --- grouped --------------------------------------------------------------


def _grouped(name: str, build: Callable[..., Column], *inputs: Column | str, **display: Any):
    return Grouped(name, inputs=tuple(as_column(c) for c in inputs), build=build, **display)


def aggregate(name: str, build: Callable[..., Column], *inputs: Column | str, **display: Any):
    """Any Spark aggregate of row expressions, e.g. ``aggregate("r", F.corr, "a", "b")``."""
    return _grouped(name, build, *inputs, **display)


def distinct_count(
    name: str, column: Column | str, approximate: bool = False, **display: Any
) -> Grouped | Additive:
    """Distinct values, null counting as one of them.

    The approximate one keeps a sketch per finest group (about 1.6 % standard
    error); sketches unite for subtotals, running groups and sources.

    The second input tells nulls of the data from rows blanked out because they
    belong to another source.
    """
    c = as_column(column)
    null = c.isNull().cast("int")
    display = {"decimals": 0, **display}
    if approximate:
        parts = {"s": Part(F.when(c.isNotNull(), F.xxhash64(c)), "hll"), "null": Part(null, "max")}

        def estimate(p: Mapping[str, Column]) -> Column:
            return F.coalesce(F.hll_sketch_estimate(p["s"]), F.lit(0)) + _sum(p, "null")

        return Additive(name, parts=parts, finish=estimate, **display)
    return Grouped(
        name,
        inputs=(c, null),
        build=lambda v, null: F.count_distinct(v) + F.coalesce(F.max(null), F.lit(0)),
        **display,
    )


# --- holistic -------------------------------------------------------------


def quantile(
    name: str,
    column: str,
    fraction: float = 0.5,
    interpolation: str = "nearest",
    limit: int = MAP_LIMIT,
    **display: Any,
) -> Quantile:
    """Exact quantile per group; nearest rank by default."""
    return Quantile(name, column=column, ask=Ask(fraction, interpolation), limit=limit, **display)


def median(name: str, column: str, **display: Any) -> Quantile:
    """Middle value, or the mean of the middle two."""
    return quantile(name, column, 0.5, "linear", **display)


def approximate_quantile(
    name: str, column: Column | str, fraction: float, accuracy: int = 10_000, **display: Any
) -> Grouped:
    """Sketch-based quantile: one pass, fixed memory, rank error 1 / accuracy."""
    return _grouped(name, lambda c: F.percentile_approx(c, fraction, accuracy), column, **display)


def mode(name: str, column: str, **display: Any) -> Holistic:
    """Most frequent value; the smallest on ties."""

    def plan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        return most_frequent(df, column, keys).withColumnRenamed("mode", "value")

    def at_levels(df: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]]) -> DataFrame:
        return level_modes(df, column, dims, levels).withColumnRenamed("mode", "value")

    def running(df: DataFrame, ordinal: str, count: int) -> DataFrame:
        reaching = F.explode(F.sequence(F.col(ordinal), F.lit(count - 1)))
        found = level_modes(df, column, [ordinal], [[ordinal]], lambda c: c.withColumn(ordinal, reaching))
        return found.select(ordinal, F.col("mode").alias("value"))

    return Holistic(name, plan=plan, at_levels=at_levels, running_plan=running, **display)


def autocorrelation(
    name: str, column: str, order_by: Sequence[str], limit: int = DISTINCT_LIMIT, **display: Any
) -> Holistic:
    """Correlation with the previous row. Tables have no row order: give one.

    Rows that tie in it are ordered by the value.
    """
    if not order_by:
        raise ValueError("autocorrelation needs an order")
    order = [*order_by, *(c for c in [column] if c not in order_by)]
    all_rows = [F.lit(True)]

    def plan(df: DataFrame, keys: Sequence[str]) -> DataFrame:
        rows = ranged_rows(df, order, limit)
        return autocorrelations(rows, keys, order, column, all_rows).drop(VIEW)

    def at_levels(df: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]]) -> DataFrame:
        rows = ranged_rows(df, order, limit)
        pieces = [
            rolled_up(autocorrelations(rows, level, order, column, all_rows), df, dims, level, "value")
            for level in levels
        ]
        return reduce(DataFrame.unionByName, pieces)

    def running(df: DataFrame, ordinal: str, count: int) -> DataFrame:
        views = [F.col(ordinal) <= i for i in range(count)]
        found = autocorrelations(ranged_rows(df, order, limit), [], order, column, views)
        return found.select(F.col(VIEW).alias(ordinal), "value")

    return Holistic(name, plan=plan, at_levels=at_levels, running_plan=running, **display)


# --- standard metrics -----------------------------------------------------

MONTHS_PER_YEAR = 12


def _annualised(mob: int) -> float:
    if mob <= 0:
        raise ValueError("months on book must be positive")
    return MONTHS_PER_YEAR / mob


def volume(name: str = "Volume", **display: Any) -> Additive:
    return row_count(name, **display)


def unit_bad_rate(name: str, bad: Column | str, mob: int = 12, **display: Any) -> Additive:
    """Bad accounts over all accounts, annualised, in percent."""
    style = {"percentage": True, "thousands": False, **display}
    return quotient(name, bad, F.lit(1).cast("bigint"), _annualised(mob), **style)


def dollar_bad_rate(
    name: str, bad: Column | str, balance: Column | str, mob: int = 12, **display: Any
) -> Additive:
    """Bad balance over average balance, annualised, in percent."""
    style = {"percentage": True, "thousands": False, **display}
    return quotient(name, bad, balance, _annualised(mob), **style)


def _member(column: Column | str, values: Sequence[Any]) -> Column:
    return F.when(as_column(column).isin(list(values)), F.lit(1)).otherwise(0).cast("bigint")


def approval_rate(
    name: str,
    status: Column | str,
    approved: Sequence[Any],
    declined: Sequence[Any],
    **display: Any,
) -> Additive:
    """Approved over approved plus declined."""
    decided = [*approved, *declined]
    return quotient(name, _member(status, approved), _member(status, decided), **display)


def overall_approval_rate(
    name: str, status: Column | str, approved: Sequence[Any], **display: Any
) -> Additive:
    """Approved in the group over all rows of the filtered table."""
    return Additive(
        name,
        parts={"n": Part(_member(status, approved))},
        finish=lambda p: ratio(_sum(p, "n"), p[TOTAL_SIZE]),
        uses_total_size=True,
        **display,
    )


def missing(name: str, **display: Any) -> Additive:
    """Placeholder for a metric whose inputs are not set: always null."""
    return Additive(name, parts={}, finish=lambda p: F.lit(None).cast("double"), **display)
