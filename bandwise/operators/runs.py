"""Correlation with the previous row, from runs that merge.

Rows are sorted in ranges. A range keeps, per key and view, the first and last value and the
moments of the pairs inside it; the pair across a border comes from the last value before and
the first one behind. A view is a subset of the rows with an order of its own, such as all
rows up to a group: every row is sorted once, whatever the number of views it is in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwise.operators.moments import Moments, correlation_of, merge
from bandwise.operators.ordering import RANGE

VIEW = "__view__"


def autocorrelations(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, views: Sequence[Column]
) -> DataFrame:
    """Correlation of ``value`` with its predecessor: ``(keys, VIEW, value)``.

    ``rows`` carry their range number; views are numbered from 0. Rows that tie in ``order``
    are ordered by the value, so that ties do not depend on where rows come from.
    """
    keys = list(keys)
    order = [*order, *(c for c in [value] if c not in order)]
    before = Window.partitionBy(*keys, RANGE).orderBy(*order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    entry, place = F.struct(F.col(value).cast("double").alias("value")), F.struct(*order)
    states = [Moments(f"v{i}", pair=True) for i in range(len(views))]
    lagged = rows.withColumns(
        {f"b{i}": F.last(F.when(view, entry), ignorenulls=True).over(before) for i, view in enumerate(views)}
    )
    aggregates = []
    for i, (view, state) in enumerate(zip(views, states)):
        seen = F.when(view, F.col(value))
        aggregates += state.of_rows(seen, F.col(f"b{i}.value"))
        aggregates.append(F.min_by(entry, F.when(view, place)).alias(f"first{i}"))
        aggregates.append(F.max_by(entry, F.when(view, place)).alias(f"last{i}"))
    per_range = lagged.groupBy(*keys, RANGE).agg(*aggregates)

    whole = Moments("run", pair=True)
    parts = ["n", *whole.means, *whole.sums]
    per_view = [
        F.struct(
            F.lit(i).alias(VIEW),
            F.col(f"first{i}").alias("first"),
            F.col(f"last{i}").alias("last"),
            F.struct(*[state.columns()[p].alias(p) for p in parts]).alias("inside"),
        )
        for i, state in enumerate(states)
    ]
    runs = per_range.select(*keys, RANGE, F.explode(F.array(*per_view)).alias("__run__"))
    runs = runs.select(*keys, RANGE, "__run__.*")
    earlier = Window.partitionBy(*keys, VIEW).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("carried", F.last("last", ignorenulls=True).over(earlier))
    x, y = F.col("first.value"), F.col("carried.value")
    pair = x.isNotNull() & y.isNotNull()
    nothing = F.lit(0.0)
    border = {"n": F.when(pair, 1.0).otherwise(0.0), "x": F.when(pair, x), "y": F.when(pair, y)}
    across = F.struct(*[border.get(p, nothing).alias(p) for p in parts])
    pieces = runs.select(*keys, VIEW, F.explode(F.array("inside", across)).alias("__piece__"))
    pieces = pieces.select(*keys, VIEW, *[F.col(f"__piece__.{p}").alias(whole.name(p)) for p in parts])
    merged = merge(pieces, [*keys, VIEW], [whole])
    return merged.select(*keys, VIEW, correlation_of(whole.columns()).alias("value"))
