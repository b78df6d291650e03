"""Bands: the ordered pieces one variable is cut into.

Numeric bands are intervals open on the left, closed on the right. Bands are
configuration of a few rows; they live on the driver as ``Band`` and go into
plans as literals, or as the columns ``band_id, lower, upper`` /
``band_id, category`` of a small table. A category table may be long, so it
stays a DataFrame and is joined, not collected.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace
from operator import attrgetter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from bandwise.functions.predicates import first_match
from bandwise.operators.bounded import bounded_rows
from bandwise.operators.ordering import (
    DISTINCT_LIMIT,
    bucket_of,
    ranged,
    with_positions,
)
from bandwise.operators.quantiles import MAP_LIMIT, column_quantiles

INF = float("inf")
MAX_CATEGORIES = 20

NUMERIC_SCHEMA = "band_id int, lower double, upper double"
_CHAIN_LIMIT = 24


@dataclass(frozen=True)
class Band:
    """An interval ``(lower, upper]``, or a set of categories when given."""

    id: int
    lower: float = -INF
    upper: float = INF
    categories: frozenset[str] | None = None

    def __post_init__(self):
        for name, bound in (("lower", -INF), ("upper", INF)):
            value = getattr(self, name)
            if value is None or value != value:
                object.__setattr__(self, name, bound)


def bands_frame(spark: SparkSession, bands: Sequence[Band]) -> DataFrame:
    return spark.createDataFrame([(b.id, float(b.lower), float(b.upper)) for b in bands], NUMERIC_SCHEMA)


def collect_bands(frame: DataFrame) -> list[Band]:
    """A numeric band table as driver-side configuration."""
    rows = bounded_rows(frame.select("band_id", "lower", "upper").orderBy("band_id"))
    return [Band(*row) for row in rows]


def collect_categories(frame: DataFrame, limit: int = MAX_CATEGORIES) -> list[Band]:
    """A category table as bands; refused when there are more categories than ``limit``.

    Longer tables stay DataFrames and are joined with ``assign_lookup``.
    """
    rows = frame.select("band_id", "category").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} categories; use the table itself as a lookup")
    members: dict[int, set[str]] = {}
    for band_id, category in rows:
        found = members.setdefault(band_id, set())
        if category is not None:
            found.add(category)
    return [Band(i, categories=frozenset(members[i])) for i in sorted(members)]


# --- assignment -----------------------------------------------------------


def _disjoint(bands: Sequence[Band]) -> list[Band] | None:
    ordered = sorted((b for b in bands if b.lower < b.upper), key=lambda b: b.lower)
    clash = any(a.upper > b.lower for a, b in zip(ordered, ordered[1:]))
    return None if clash else ordered


def assign_numeric(value: Column, bands: Sequence[Band]) -> Column:
    """Id of the first band with ``lower < value <= upper``; null if none.

    A handful of bands is a CASE. Many disjoint ones are found by binary search
    over their bounds, so the cost per row grows with the logarithm.
    """
    x = value.cast("double")
    ordered = _disjoint(bands) if len(bands) > _CHAIN_LIMIT else None
    if ordered is None:
        cases = (
            ((x > F.lit(float(b.lower))) & (x <= F.lit(float(b.upper))), F.lit(b.id))
            for b in bands
        )
        return first_match(cases, F.lit(None).cast("int"))
    at = bucket_of(x, [float(b.upper) for b in ordered])
    lower = F.get(F.lit([float(b.lower) for b in ordered]), at)
    return F.when(
        (x > lower) & (at < len(ordered)), F.get(F.lit([b.id for b in ordered]), at)
    )


def assign_categories(value: Column, bands: Sequence[Band]) -> Column:
    """Id of the first band whose categories contain the value; null if none."""
    text = value.cast("string")
    cases = ((text.isin(sorted(b.categories)), F.lit(b.id)) for b in bands if b.categories)
    return first_match(cases, F.lit(None).cast("int"))


def assign(value: Column, bands: Sequence[Band]) -> Column:
    """Band of a value, by interval or by category."""
    if any(b.categories is not None for b in bands):
        return assign_categories(value, bands)
    return assign_numeric(value, bands)


def assign_lookup(df: DataFrame, column: str, categories: DataFrame, out: str) -> DataFrame:
    """Band of a category by join, for tables too long for an expression.

    A category listed in several bands belongs to the lowest. Spark broadcasts
    the table if its measured size allows; otherwise a hot category is split by
    the adaptive skew join.
    """
    first = (
        categories.filter(F.col("category").isNotNull())
        .groupBy(F.col("category").alias("__category__"))
        .agg(F.min("band_id").alias("__band__"))
    )
    joined = df.join(first, F.col(column).cast("string") == F.col("__category__"), "left")
    return joined.withColumn(out, F.col("__band__")).drop("__category__", "__band__")


# --- making bands ---------------------------------------------------------


def quantile_bands(
    df: DataFrame, column: str, count: int, limit: int = MAP_LIMIT
) -> list[Band]:
    """``count`` bands cut at equal quantiles; the outer bounds are unbounded."""
    if count <= 0:
        return []
    fractions = [i / count for i in range(1, count)]
    cuts = column_quantiles(df, [column], fractions, limit)[column]
    edges = [-INF, *(-INF if c is None else c for c in cuts), INF]
    return [Band(i, edges[i], edges[i + 1]) for i in range(count)]


def even_category_bands(
    df: DataFrame, column: str, count: int, limit: int = DISTINCT_LIMIT
) -> DataFrame:
    """Sorted distinct values in ``count`` near-equal chunks: ``(band_id, category)``.

    The first chunks take the remainder; an empty chunk has a null category.
    Values are ranked in parallel ranges, so their number does not matter.
    """
    values = (
        df.select(F.col(column).cast("string").alias("category"))
        .filter(F.col("category").isNotNull())
        .distinct()
    )
    ranks = with_positions(
        ranged(values, "category", limit).withColumn("n", F.lit(1)), [], "category", "n"
    )
    base = F.floor(F.col("total") / count)
    extra = F.col("total") % count
    # The first `extra` chunks hold base + 1 values.
    wide = extra * (base + 1)
    chunk = F.when(
        F.col("start") < wide, F.floor(F.col("start") / (base + 1))
    ).otherwise(extra + F.floor((F.col("start") - wide) / F.greatest(base, F.lit(1))))
    placed = ranks.select(chunk.cast("int").alias("band_id"), "category")
    ids = df.sparkSession.range(count).select(F.col("id").cast("int").alias("band_id"))
    # Only ids meet in the join; a join with the categories would put each band into one task.
    empty = ids.join(placed.select("band_id").distinct(), "band_id", "left_anti")
    return placed.unionByName(empty.withColumn("category", F.lit(None).cast("string")))


def numeric_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of several variables, one row each, from one pass."""
    bounds = df.agg(
        *(F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(columns)),
        *(F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(columns)),
    )
    entries = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"lo{i}").alias("minimum"),
            F.col(f"hi{i}").alias("maximum"),
        )
        for i, c in enumerate(columns)
    ]
    return bounds.select(F.inline(F.array(*entries)))


def clip_outer_bounds(
    bands: Sequence[Band], minimum: float | None, maximum: float | None, include_min: bool = True
) -> list[Band]:
    """Outer bounds replaced by the range of the data.

    With ``include_min`` the lowest bound stays where it was if that is below
    the minimum and finite, so that the row at the minimum keeps its band:
    intervals are open on the left.
    """
    if not bands or minimum is None or maximum is None:
        return list(bands)
    rising = sorted(bands, key=attrgetter("lower", "upper", "id"))
    start = rising[0].lower
    if not (include_min and math.isfinite(start) and start < minimum):
        start = minimum
    opened = [replace(rising[0], lower=start), *rising[1:]]
    highest = sorted(opened, key=attrgetter("upper", "lower", "id"))[-1]
    by_id = {b.id: replace(b, upper=maximum) if b is highest else b for b in opened}
    return [by_id[b.id] for b in bands]


# --- checks and description -----------------------------------------------


def check_numeric_bands(bands: DataFrame) -> DataFrame:
    """Problems of a numeric band table: ``(severity, band_id, problem)``."""
    invalid = bands.filter("lower >= upper").select(
        F.lit("warning").alias("severity"), "band_id", F.lit("lower >= upper").alias("problem")
    )
    valid = bands.filter("lower < upper")
    by_lower = Window.orderBy("lower", "band_id")
    overlaps = (
        valid.withColumn("__next__", F.lead("lower").over(by_lower))
        .filter("upper > __next__")
        .select(F.lit("error").alias("severity"), "band_id", F.lit("overlap").alias("problem"))
    )
    by_id = Window.orderBy("band_id")
    steps = valid.select(
        *(F.col(c) - F.lag(c).over(by_id) for c in ("lower", "upper"))
    ).toDF("lower", "upper")
    trends = steps.agg(
        *(
            (F.max(F.when(F.col(c) > 0, 1)).isNotNull() & F.max(F.when(F.col(c) < 0, 1)).isNotNull()).alias(c)
            for c in ("lower", "upper")
        )
    )
    shape = trends.select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit("warning").alias("severity"),
                        F.lit(None).cast("int").alias("band_id"),
                        F.lit(f"{c} bounds not monotonic").alias("problem"),
                        F.col(c).alias("found"),
                    )
                    for c in ("lower", "upper")
                )
            )
        )
    ).filter("found")
    return invalid.unionByName(overlaps).unionByName(shape.drop("found"))


def check_category_bands(categories: DataFrame) -> DataFrame:
    """Problems of a category table: ``(severity, band_id, category, problem)``."""
    empty = (
        categories.groupBy("band_id")
        .agg(F.count("category").alias("n"))
        .filter("n = 0")
        .select(
            F.lit("warning").alias("severity"),
            "band_id",
            F.lit(None).cast("string").alias("category"),
            F.lit("empty band").alias("problem"),
        )
    )
    repeated = (
        categories.filter("category is not null")
        .groupBy("category")
        .agg(F.count_distinct("band_id").alias("n"), F.max("band_id").alias("band_id"))
        .filter("n > 1")
        .select(
            F.lit("error").alias("severity"),
            "band_id",
            "category",
            F.lit("category in several bands").alias("problem"),
        )
    )
    return empty.unionByName(repeated)


def check_variable(
    df: DataFrame, column: str, numeric: bool, max_categories: int | None = MAX_CATEGORIES
) -> list[str]:
    """Reasons why a variable cannot be banded as wanted; empty if it can.

    Without a limit on categories, as where they go to a table, nothing is counted.
    """
    if column not in df.columns:
        return [f"column {column!r} does not exist"]
    is_number = isinstance(df.schema[column].dataType, NumericType)
    problems = []
    if numeric and not is_number:
        problems.append(f"column {column!r} is not numeric")
    if max_categories is not None and (not numeric or not is_number):
        count = category_count(df, column).first()["categories"]
        if count > max_categories:
            problems.append(f"column {column!r} has {count} categories, limit {max_categories}")
    return problems


def category_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct non-null values, one row."""
    return df.agg(F.count_distinct(column).alias("categories"))


def describe_bands(bands: DataFrame) -> DataFrame:
    """Display text of numeric bands, ``(lower - upper]``."""
    text = F.concat(F.lit("("), F.col("lower"), F.lit(" - "), F.col("upper"), F.lit("]"))
    return bands.select("band_id", text.alias("band"))


def describe_categories(bands: Sequence[Band]) -> dict[int, str]:
    """Display text of category bands: their categories in order."""
    return {b.id: ", ".join(sorted(b.categories or ())) for b in bands}

