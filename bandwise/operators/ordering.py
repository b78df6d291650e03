"""Order-dependent work without ever sorting a whole table in one task.

A global window (``Window.orderBy`` with no partition) or one over a hot key
pulls all its rows into a single task. Here the ordered column is first cut
into ranges at edges taken from a small sketch. Ranges are sorted in parallel,
and what crosses a range border (rows before it, last value of the previous
range) is carried by a second aggregate holding one row per key and range.

The edges decide only how evenly work is spread, never the result, so an
approximate sketch is enough. They are read once and put into the plan as
literals: a recomputed task must see the same ranges.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    DoubleType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from bandwise.functions.predicates import first_match

# Above this many distinct values, ordering is spread over ranges.
DISTINCT_LIMIT = 200_000
RANGES = 512
RANGE = "__range__"

_CHAIN_LIMIT = 24


def bucket_of(
    value: Column, edges: Sequence[Any], value_type: DataType | None = None
) -> Column:
    """Number of sorted ``edges`` below the value: buckets are open on the left.

    Few edges become a CASE, which stays inside generated code; many become a
    binary search over one constant array, of doubles unless said otherwise.
    """
    if not edges:
        return F.when(value.isNotNull(), F.lit(0))
    if len(edges) <= _CHAIN_LIMIT:
        below = ((value <= F.lit(e), F.lit(i)) for i, e in enumerate(edges))
        missing = (value.isNull(), F.lit(None).cast("int"))
        return first_match([missing, *below], F.lit(len(edges)))
    kind = value_type or DoubleType()
    return F.when(value.isNotNull(), _search(value, literal_array(edges, kind), len(edges)))


def literal_array(values: Sequence[Any], kind: DataType) -> Column:
    """A sorted constant array, passed to the JVM as one string instead of one call per entry.

    It is sorted again there, so that the order holds for the values as parsed.
    """
    text = json.dumps([_texts(v) for v in values])
    plain = StringType()
    if isinstance(kind, StructType):
        plain = StructType([StructField(f.name, StringType()) for f in kind.fields])
    parsed = F.from_json(F.lit(text), ArrayType(plain))
    return F.sort_array(parsed.cast(ArrayType(kind)))


def _texts(value: Any) -> Any:
    if isinstance(value, dict):
        return {name: _texts(v) for name, v in value.items()}
    return None if value is None else str(value)


def _search(value: Column, edges: Column, count: int) -> Column:
    """Binary search: number of entries of a sorted array below the value."""
    steps = [1 << k for k in reversed(range(count.bit_length()))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(F.get(edges, at + step - 1) < value, at + step).otherwise(at),
    )


def with_buckets(
    df: DataFrame, edges: Mapping[str, Sequence[float]], names: Mapping[str, str]
) -> DataFrame:
    """``bucket_of`` for double columns of all rows, as further columns.

    An eight-way search in three projections, which stay inside generated code;
    each refers to the step before it as a column, so nothing is repeated.
    ``edges`` and ``names`` (of the new columns) go by column; 511 edges at most.
    """
    few = {c: e for c, e in edges.items() if len(e) <= _CHAIN_LIMIT}
    many = {c: sorted(e) for c, e in edges.items() if c not in few}
    size = 512
    literals = {}
    for c, e in many.items():
        if len(e) >= size:
            raise ValueError(f"at most {size - 1} edges can be searched")
        literals[c] = F.lit([float(x) for x in e] + [float("inf")] * (size - 1 - len(e)))
    at = {c: F.lit(0) for c in many}
    step = size
    while many and step > 1:
        step //= 8
        found = {}
        for c in many:
            places = (at[c] + (j * step - 1) for j in range(1, 8))
            above = [(F.col(c) > F.get(literals[c], place)).cast("int") for place in places]
            found[names[c]] = at[c] + step * reduce(lambda a, b: a + b, above)
        df = df.withColumns(found)
        at = {c: F.col(names[c]) for c in many}
    # NaN lies above the padding as well.
    last = {names[c]: F.least(F.col(names[c]), F.lit(len(e))) for c, e in many.items()}
    return df.withColumns(last | {names[c]: bucket_of(F.col(c), e) for c, e in few.items()})


@dataclass(frozen=True)
class Sketch:
    """Approximate number of distinct values, and range edges where they can be sketched."""

    distinct: int
    edges: list[Any] | None


def _can_sketch(df: DataFrame, column: str) -> bool:
    kinds = (NumericType, DateType, TimestampType, TimestampNTZType)
    return isinstance(df.schema[column].dataType, kinds)


def sketch_aggregates(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates behind ``read_sketches``, to be combined with others of the same pass."""
    fractions = F.expr(f"array({', '.join(f'{i / RANGES}D' for i in range(1, RANGES))})")
    found = []
    for i, c in enumerate(columns):
        found.append(F.approx_count_distinct(F.col(c)).alias(f"__distinct{i}__"))
        if _can_sketch(df, c):
            edges = F.percentile_approx(F.col(c), fractions, 4 * RANGES)
            found.append(edges.alias(f"__edges{i}__"))
    return found


def read_sketches(df: DataFrame, columns: Sequence[str], row: Row) -> dict[str, Sketch]:
    result = {}
    for i, c in enumerate(columns):
        edges = None
        if _can_sketch(df, c):
            edges = sorted({e for e in (row[f"__edges{i}__"] or []) if e == e})
        result[c] = Sketch(row[f"__distinct{i}__"], edges)
    return result


def sketch_columns(df: DataFrame, columns: Sequence[str]) -> dict[str, Sketch]:
    """Sketches of several columns from one pass; their size does not depend on the data."""
    if not columns:
        return {}
    return read_sketches(df, columns, df.agg(*sketch_aggregates(df, columns)).first())


def _text_edges(df: DataFrame, column: str) -> list[str]:
    """Edges from the distinct values with the smallest hashes, a fixed-size sample."""
    if not isinstance(df.schema[column].dataType, StringType):
        raise TypeError(f"cannot order by {column!r} of type {df.schema[column].dataType}")
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    rows = values.orderBy(F.xxhash64(column), column).limit(8 * RANGES).collect()
    return _every_nth(sorted(r[0] for r in rows))


def _every_nth(ordered: list) -> list:
    step = max(1, len(ordered) // RANGES)
    return ordered[step - 1 :: step][: RANGES - 1]


def range_edges(
    df: DataFrame, column: str, sketch: Sketch | None = None, limit: int = DISTINCT_LIMIT
) -> list[Any]:
    """Edges cutting a column into about equal parts; none if it has few distinct values."""
    if sketch is None:
        sketch = sketch_columns(df, [column])[column]
    if sketch.distinct <= limit:
        return []
    return _text_edges(df, column) if sketch.edges is None else sketch.edges


def ranged_rows(
    df: DataFrame, order_by: Sequence[str], limit: int = DISTINCT_LIMIT
) -> DataFrame:
    """Add the range number of each row in the order of several columns.

    Edges are whole ordering tuples, so one value of the first column may hold
    any share of the rows: the later columns split it. ``limit`` is in rows, as
    the work is; equal tuples stay together.
    """
    place = F.struct(*order_by)
    if df.count() <= limit:
        return df.withColumn(RANGE, F.lit(0))
    # Repeats are counted before the sample is taken, so they weigh but don't crowd out others.
    tuples = df.groupBy(*order_by).agg(F.count("*").alias("__rows__"))
    sample = tuples.orderBy(F.xxhash64(*order_by), *order_by).limit(8 * RANGES).collect()
    rows = _heavy_edges(sorted(((tuple(r)[:-1], r["__rows__"]) for r in sample), key=_nulls_first))
    kind = StructType([df.schema[c] for c in order_by])
    edges = literal_array([dict(zip(order_by, row)) for row in rows], kind)
    return df.withColumn(RANGE, _search(place, edges, len(rows)))


def _nulls_first(entry: tuple[tuple, int]) -> tuple:
    return tuple((v is not None, v) for v in entry[0])


def _heavy_edges(weighted: list[tuple[tuple, int]]) -> list[tuple]:
    """Tuples at which a range is full: each holds at least its share of the sampled rows."""
    share = sum(n for _, n in weighted) / RANGES
    edges, held = [], 0
    for place, n in weighted[:-1]:
        held += n
        if held >= share:
            edges.append(place)
            held = 0
    return edges[: RANGES - 1]


def ranged(df: DataFrame, column: str, limit: int = DISTINCT_LIMIT) -> DataFrame:
    """Add the range number of ``column``; one range when it has few distinct values."""
    edges = range_edges(df, column, limit=limit)
    return df.withColumn(RANGE, bucket_of(F.col(column), edges, df.schema[column].dataType))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join in which null keys match; the key columns appear once."""
    if not keys:
        return left.crossJoin(right)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__right__{k}")
    on = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__right__{k}")) for k in keys))
    joined = left.join(renamed, on, how)
    if how in ("full", "full_outer", "outer", "right"):
        columns = [F.coalesce(F.col(k), F.col(f"__right__{k}")).alias(k) for k in keys]
    else:
        columns = [F.col(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*columns, *rest)


def range_offsets(
    per_range: DataFrame,
    keys: Sequence[str],
    weight: str,
    wanted: Callable[[Column, Column, Column], Column] | None = None,
) -> DataFrame:
    """What lies before each range of a key: ``__before__`` rows, of ``total``.

    ``per_range`` holds one row per key and range. If given, ``wanted(start,
    end, total)`` is an array of what is looked for in a range; ranges with an
    empty one are dropped, the others keep it as ``wanted``.
    """
    keys = list(keys)
    by_range = Window.partitionBy(*keys).orderBy(RANGE)
    earlier = by_range.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        RANGE,
        F.col(weight).alias("__in_range__"),
        F.coalesce(F.sum(weight).over(earlier), F.lit(0)).alias("__before__"),
        F.sum(weight).over(Window.partitionBy(*keys)).alias("total"),
    )
    if wanted is not None:
        end = F.col("__before__") + F.col("__in_range__")
        offsets = offsets.withColumn("wanted", wanted(F.col("__before__"), end, F.col("total")))
        offsets = offsets.filter(F.size("wanted") > 0)
    return offsets.drop("__in_range__")


def with_positions(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    wanted: Callable[[Column, Column, Column], Column] | None = None,
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Rank of every distinct value within its key, in ascending order.

    ``counts`` holds one row per key, range and value, with its multiplicity.
    Adds ``start`` (rows of the key before this value) and ``total``. Ranges
    without anything ``wanted`` are dropped before their rows are shuffled and
    sorted. With ``offsets`` from ``range_offsets``, ``counts`` need only hold
    the ranges that are in them.
    """
    keys = list(keys)
    if offsets is None:
        per_range = counts.groupBy(*keys, RANGE).agg(F.sum(weight).alias("__rows__"))
        offsets = range_offsets(per_range, keys, "__rows__", wanted)
    inside = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = null_safe_join(counts, offsets, [*keys, RANGE])
    end = F.col("__before__") + F.sum(weight).over(inside)
    return located.withColumn("start", end - F.col(weight)).drop("__before__")


def adjacent_pairs(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str
) -> DataFrame:
    """Every row's value beside the previous one in order: ``(keys, value, previous)``.

    ``df`` carries the range number of the first ordering column. The pair that
    straddles two ranges comes from the first and last value of each range.
    """
    keys = list(keys)
    order = F.struct(*order_by)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order_by)
    within = df.select(
        *keys,
        F.col(value).alias("value"),
        F.lag(value).over(inside).alias("previous"),
        F.row_number().over(inside).alias("__row__"),
    ).filter("__row__ > 1")
    ends = df.groupBy(*keys, RANGE).agg(
        F.min_by(value, order).alias("value"), F.max_by(value, order).alias("__last__")
    )
    across = ends.withColumn(
        "previous", F.lag("__last__").over(Window.partitionBy(*keys).orderBy(RANGE))
    )
    return within.drop("__row__").unionByName(across.select(*keys, "value", "previous"))
