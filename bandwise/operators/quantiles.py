"""Exact quantiles of columns and groups of any size.

``percentile`` builds a map of distinct values in every task and merges all of
them in one; it is used only while a distinct-count sketch says that the maps
are tiny. Otherwise ranks are selected in two scans. The first counts rows per
group and range of values, which is a small table however many values there
are, and says which ranges hold a wanted rank. The second counts the values in
those ranges only (so a value holding a third of the table is one row), and
they are ranked in parallel. No other value is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.predicates import first_match
from bandwise.operators.ordering import (
    DISTINCT_LIMIT,
    RANGE,
    Sketch,
    adjacent_pairs,
    bucket_of,
    range_edges,
    range_offsets,
    ranged,
    sketch_columns,
    with_buckets,
    with_positions,
)

# Up to this many distinct values, maps from ten thousand tasks fit into one.
MAP_LIMIT = 10_000

LEVEL = "__level__"

INTERPOLATIONS = ("linear", "nearest", "lower", "higher", "midpoint")


@dataclass(frozen=True)
class Ask:
    """One wanted quantile."""

    fraction: float
    interpolation: str = "linear"

    def __post_init__(self):
        if self.interpolation not in INTERPOLATIONS:
            raise ValueError(f"unknown interpolation {self.interpolation!r}")
        if not 0 <= self.fraction <= 1:
            raise ValueError("a quantile lies between 0 and 1")

    @property
    def sides(self) -> list[str]:
        """Which ranks around the fractional position make up the quantile."""
        return {
            "nearest": ["near"], "lower": ["below"], "higher": ["above"],
        }.get(self.interpolation, ["below", "above"])


@dataclass(frozen=True)
class _Slots:
    """The ranks that several quantiles are made of, numbered."""

    asks: Sequence[Ask]

    @property
    def pairs(self) -> list[tuple[float, str]]:
        return [(ask.fraction, side) for ask in self.asks for side in ask.sides]

    @property
    def fractions(self) -> Column:
        return F.lit([float(fraction) for fraction, _ in self.pairs])

    @property
    def every(self) -> Column:
        return F.lit(list(range(len(self.pairs))))

    def rank(self, slot: Column, total: Column) -> Column:
        """Zero-based rank of the value that belongs into a slot."""
        h = (total - 1) * F.get(self.fractions, slot)
        side = F.get(F.lit([side for _, side in self.pairs]), slot)
        return F.when(side == "below", F.floor(h)).when(side == "above", F.ceil(h)).otherwise(
            F.floor(h + 0.5)
        )

    def between(self, some: Column, start: Column, end: Column, total: Column) -> Column:
        """Those of some slots whose ranks lie in an interval."""
        return F.filter(
            some, lambda slot: (self.rank(slot, total) >= start) & (self.rank(slot, total) < end)
        )

    def within(self, start: Column, end: Column, total: Column) -> Column:
        return self.between(self.every, start, end, total)


def quantiles_of_counts(
    counts: DataFrame,
    keys: Sequence[str],
    asks: Sequence[Ask],
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Quantiles from a table of ``(keys, range, value, n)``: keys and ``quantiles``.

    ``offsets`` says what lies before the ranges, if ``counts`` holds only some.
    """
    keys = list(keys)
    slots = _Slots(asks)
    fractions = slots.fractions
    placed = with_positions(counts, keys, "value", "n", slots.within, offsets)
    start = F.col("start")
    hits = slots.between(F.col("wanted"), start, start + F.col("n"), F.col("total"))
    found = placed.select(*keys, "value", "total", F.explode(hits).alias("slot"))
    # One entry per slot and key.
    grouped = found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("entries"),
        F.max("total").alias("total"),
    )
    firsts = F.lit([sum(len(a.sides) for a in asks[:i]) for i in range(len(asks))])
    widths = F.lit([len(a.sides) for a in asks])
    halves = F.lit([a.interpolation == "midpoint" for a in asks])

    def quantile(i: Column) -> Column:
        first = F.get(firsts, i)
        low = F.get("entries", first).getField("value")
        high = F.get("entries", first + F.get(widths, i) - 1).getField("value")
        h = (F.col("total") - 1) * F.get(fractions, first)
        share = F.when(F.get(halves, i), F.lit(0.5)).otherwise(h - F.floor(h))
        # Not low + (high - low) * share, which is NaN between infinities.
        between = low * (1 - share) + high * share
        return F.when((low == high) | (share == 0), low).otherwise(between)

    wanted = F.lit(list(range(len(asks))))
    return grouped.select(*keys, F.transform(wanted, quantile).alias("quantiles"))


def value_counts(
    df: DataFrame, keys: Sequence[str], variables: Sequence[Column]
) -> DataFrame:
    """Rows per key, variable number and distinct value, for all variables from one pass."""
    entries = [
        F.struct(F.lit(i).alias("variable"), v.cast("double").alias("value"))
        for i, v in enumerate(variables)
    ]
    return (
        df.select(*keys, F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _ranged_entries(
    df: DataFrame, keys: Sequence[str], variables: Sequence[Column], edges: Sequence[Sequence[float]]
) -> DataFrame:
    """A row per key, variable number and value, with the range of the value."""
    values = {f"__value{i}__": v.cast("double") for i, v in enumerate(variables)}
    slim = df.select(*keys, *(v.alias(name) for name, v in values.items()))
    ranges = {name: f"__range{i}__" for i, name in enumerate(values)}
    placed = with_buckets(slim, dict(zip(values, edges)), ranges)
    entries = [
        F.struct(F.lit(i).alias("variable"), F.col(v).alias("value"), F.col(r).alias(RANGE))
        for i, (v, r) in enumerate(ranges.items())
    ]
    return placed.select(*keys, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def _at_levels(
    counts: DataFrame, keys: Sequence[str], levels: Mapping[int, Sequence[str]] | None
) -> DataFrame:
    """Every row once per level, with the number of the level and nulls for keys it has not."""
    if levels is None:
        return counts.withColumn(LEVEL, F.lit(0))
    entries = []
    for number, kept in levels.items():
        own = [
            (F.col(k) if k in kept else F.lit(None).cast(counts.schema[k].dataType)).alias(k)
            for k in keys
        ]
        entries.append(F.struct(*own, F.lit(number).alias(LEVEL)))
    rest = [c for c in counts.columns if c not in keys]
    return counts.select(*rest, F.inline(F.array(*entries)))


def selected_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    variables: Sequence[Column],
    asks: Sequence[Ask],
    edges: Sequence[Sequence[float]],
    levels: Mapping[int, Sequence[str]] | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Quantiles of several variables by rank selection: keys, ``__level__``, ``variable``, ``quantiles``.

    ``edges`` cut each variable into ranges. The ranges that hold a wanted rank
    of any key are at most all ranges of all variables, so they are broadcast;
    with few keys they are a small share, and with many keys each holds few
    rows of a range. ``levels`` are numbered subsets of the keys to which the
    small counts roll up; ``spread`` may send counts to several groups.
    """
    keys = list(keys)
    slots = _Slots(asks)
    spread = spread or (lambda counts: counts)
    entries = _ranged_entries(df, keys, variables, edges)
    own, n = [*keys, LEVEL, "variable"], F.count(F.lit(1)).alias("n")

    def rolled_up(counts: DataFrame, *more: str) -> DataFrame:
        spreaded = _at_levels(spread(counts), keys, levels)
        return spreaded.groupBy(*own, RANGE, *more).agg(F.sum("n").alias("n"))

    per_range = rolled_up(entries.groupBy(*keys, "variable", RANGE).agg(n))
    offsets = range_offsets(per_range, own, "n", slots.within)
    # Bounded by variables x ranges.
    wanted = F.broadcast(offsets.select("variable", RANGE).distinct())
    near = entries.join(wanted, ["variable", RANGE], "left_semi")
    counts = rolled_up(near.groupBy(*keys, "variable", RANGE, "value").agg(n), "value")
    return quantiles_of_counts(counts, own, asks, offsets)


def level_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    variables: Sequence[Column],
    asks: Sequence[Ask],
    sketches: Sequence[Sketch],
    limit: int = MAP_LIMIT,
    levels: Mapping[int, Sequence[str]] | None = None,
    spread: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``selected_quantiles``, or maps of values where the sketches say that they are tiny."""
    limit = min(limit, MAP_LIMIT)
    if _fit_into_maps(asks, sketches, limit):
        counts = value_counts(df, keys, variables)
        counts = _at_levels(counts if spread is None else spread(counts), keys, levels)
        return _map_quantiles(counts, [*keys, LEVEL, "variable"], asks)
    edges = [s.edges or [] if s.distinct > limit else [] for s in sketches]
    return selected_quantiles(df, keys, variables, asks, edges, levels, spread)


def _fit_into_maps(asks: Sequence[Ask], sketches: Sequence[Sketch], limit: int) -> bool:
    return all(a.interpolation == "linear" for a in asks) and all(s.distinct <= limit for s in sketches)


def _map_quantiles(counts: DataFrame, keys: Sequence[str], asks: Sequence[Ask]) -> DataFrame:
    fractions = [a.fraction for a in asks]
    return counts.groupBy(*keys).agg(F.percentile("value", fractions, F.col("n")).alias("quantiles"))


def counted_quantiles(
    counts: DataFrame,
    asks: Sequence[Ask],
    sketches: Sequence[Sketch],
    limit: int = MAP_LIMIT,
) -> DataFrame:
    """Quantiles of every variable of ``value_counts``, where all values are counted anyway."""
    limit = min(limit, MAP_LIMIT)
    if _fit_into_maps(asks, sketches, limit):
        return _map_quantiles(counts, ["variable"], asks)
    value = F.col("value")
    cases = (
        (F.col("variable") == i, bucket_of(value, s.edges if s.distinct > limit else []))
        for i, s in enumerate(sketches)
    )
    placed = counts.withColumn(RANGE, first_match(cases, F.lit(None).cast("int")))
    return quantiles_of_counts(placed, ["variable"], asks)


def group_quantiles(
    df: DataFrame,
    column: str,
    fractions: Sequence[float],
    keys: Sequence[str] = (),
    interpolation: str = "linear",
    limit: int = MAP_LIMIT,
) -> DataFrame:
    """Exact quantiles per key: one row per key with an array ``quantiles``.

    Nulls are ignored; keys without values are absent from the result.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(column).cast("double").alias("value")).filter(
        F.col("value").isNotNull()
    )
    limit = min(limit, MAP_LIMIT)
    sketch = sketch_columns(values, ["value"])["value"]
    if interpolation == "linear" and sketch.distinct <= limit:
        return values.groupBy(*keys).agg(
            F.percentile("value", list(fractions)).alias("quantiles")
        ).filter(F.col("quantiles").isNotNull())
    edges = range_edges(values, "value", sketch, limit)
    asks = [Ask(q, interpolation) for q in fractions]
    found = selected_quantiles(values, keys, [F.col("value")], asks, [edges])
    return found.drop(LEVEL, "variable")


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    limit: int = MAP_LIMIT,
    sketches: Mapping[str, Sketch] | None = None,
) -> dict[str, list[float | None]]:
    """Exact linear quantiles of several columns, on the driver.

    However many columns: one pass for sketches, one over the columns with few
    distinct values, one over the others. Sketches at hand save the first.
    """
    columns = list(columns)
    missing: list[float | None] = [None] * len(fractions)
    result = {c: list(missing) for c in columns}
    if not columns or not fractions:
        return result
    values = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    if sketches is None:
        sketches = sketch_columns(values, columns)
    small = [c for c in columns if sketches[c].distinct <= min(limit, MAP_LIMIT)]
    large = [c for c in columns if c not in small]
    if small:
        row = values.agg(
            *(F.percentile(c, list(fractions)).alias(f"q{i}") for i, c in enumerate(small))
        ).first()
        for i, c in enumerate(small):
            result[c] = list(row[f"q{i}"] or missing)
    if large:
        asks, edges = [Ask(q) for q in fractions], [sketches[c].edges or [] for c in large]
        for row in selected_quantiles(values, [], [F.col(c) for c in large], asks, edges).collect():
            result[large[row["variable"]]] = list(row["quantiles"])
    return result


def level_number(dims: Sequence[str], kept: Sequence[str]) -> int:
    """Spark's grouping id: one bit per dimension, set when it is rolled up."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def rolled_up(
    found: DataFrame, rows: DataFrame, dims: Sequence[str], level: Sequence[str], value: str
) -> DataFrame:
    """Add the dimensions that are rolled up, as nulls, and the level."""
    for d in dims:
        if d not in level:
            found = found.withColumn(d, F.lit(None).cast(rows.schema[d].dataType))
    found = found.withColumn(LEVEL, F.lit(level_number(dims, level)).cast("bigint"))
    return found.select(*dims, LEVEL, value)


def most_frequent(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-null value per key as ``mode``; the smallest on ties.

    Counting by (key, value) first spreads a hot key over its values.
    """
    return _most_counted(_mode_counts(df, column, keys), keys)


def level_modes(
    df: DataFrame,
    column: str,
    dims: Sequence[str],
    levels: Sequence[Sequence[str]],
    expand: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Modes at several levels: the dimensions, ``LEVEL`` and ``mode``.

    Rows are counted once, by all dimensions and the value; levels add up those
    counts. ``expand`` may send counts to several groups.
    """
    counts = _mode_counts(df, column, dims)
    if expand is not None:
        counts = expand(counts)
    sets = [[*level, "__value__"] for level in levels]
    # The value is the last grouping column and never rolled up: its bit goes.
    level = F.shiftright(F.grouping_id(), 1).cast("bigint").alias(LEVEL)
    added = counts.groupingSets(sets, *dims, "__value__").agg(level, F.sum("__n__").alias("__n__"))
    return _most_counted(added, [*dims, LEVEL])


def _mode_counts(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    values = df.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("__value__"))
    return values.agg(F.count(F.lit(1)).alias("__n__"))


def _most_counted(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    best = F.min_by("__value__", F.struct(-F.col("__n__"), F.col("__value__")))
    return counts.groupBy(*keys).agg(best.alias("mode"))


def min_gaps(
    df: DataFrame,
    column: str,
    keys: Sequence[str] = (),
    limit: int = DISTINCT_LIMIT,
    distinct: int | None = None,
) -> DataFrame:
    """Smallest distance between neighbouring distinct values per key, as ``gap``.

    ``distinct``, if known, is the largest number of distinct values of a key.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(column).cast("double").alias("value")).filter(
        F.col("value").isNotNull()
    )
    if distinct is not None and distinct <= limit:
        placed = values.distinct().withColumn(RANGE, F.lit(0))
    else:
        placed = ranged(values, "value", limit).distinct()
    pairs = adjacent_pairs(placed, keys, ["value"], "value")
    return pairs.groupBy(*keys).agg(
        F.min(F.abs(F.col("value") - F.col("previous"))).alias("gap")
    )


def min_gap(df: DataFrame, column: str, limit: int = DISTINCT_LIMIT) -> float | None:
    """Smallest distance between neighbouring distinct values; None below two values."""
    return min_gaps(df, column, limit=limit).first()["gap"]
