"""Metrics per group, per level of subtotals, and cumulatively over ordered groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bandwise.functions.predicates import Predicate, keep
from bandwise.operators.metrics import (
    TOTAL_SIZE,
    Additive,
    Central,
    Grouped,
    Holistic,
    Metric,
    Part,
    Quantile,
)
from bandwise.operators.moments import merge
from bandwise.operators.ordering import null_safe_join, sketch_columns
from bandwise.operators.quantiles import LEVEL, level_number, level_quantiles, rolled_up
from bandwise.sources.union import SOURCE

QUANTILES = "__quantiles__"
_REACH = "__reach__"
_SALT = "__salt__"
# Tasks that share the finest groups of one subtotal.
SALTS = 64


def prepare(
    df: DataFrame,
    where: Predicate | None = None,
    with_columns: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Filter, then derive columns in order; later ones may use earlier ones."""
    result = keep(df, where)
    for name, expression in (with_columns or {}).items():
        value = F.expr(expression) if isinstance(expression, str) else expression
        result = result.withColumn(name, value)
    return result


class _Layout:
    """Names and row expressions of the partial results of a list of metrics."""

    def __init__(self, metrics: Sequence[Metric]):
        names = [m.name for m in metrics]
        if len(set(names)) != len(names):
            raise ValueError(f"metric names repeat: {sorted(names)}")
        self.metrics = list(metrics)
        self.source_sets = list(dict.fromkeys(self._key(m) for m in metrics))
        self.several = len(self.source_sets) > 1
        self.needs_rows = self.several or any(
            isinstance(m, Additive) and m.uses_total_size for m in metrics
        )
        self.grouped = [m for m in metrics if isinstance(m, Grouped)]
        self.moments = {i: m.state(f"c{i}") for i, m in enumerate(metrics) if isinstance(m, Central)}
        self.quantiles = [m for m in metrics if isinstance(m, Quantile)]
        # A variable is a column as seen by one source set.
        pairs = dict.fromkeys((m.column, self._key(m)) for m in self.quantiles)
        self.variables = list(pairs)
        self.asks = list(dict.fromkeys(m.ask for m in self.quantiles))

    @staticmethod
    def _key(metric: Metric) -> tuple[str, ...] | None:
        return None if metric.sources is None else tuple(sorted(set(metric.sources)))

    @staticmethod
    def member(sources: tuple[str, ...] | None) -> Column:
        if sources is None:
            return F.lit(True)
        return F.col(SOURCE).isin(list(sources)) if sources else F.lit(False)

    def restrict(self, df: DataFrame) -> DataFrame:
        """Rows that some metric can see."""
        if any(s is None for s in self.source_sets):
            return df
        return df.filter(reduce(or_, (self.member(s) for s in self.source_sets)))

    def visible(self, df: DataFrame, metric: Metric) -> DataFrame:
        key = self._key(metric)
        return df if key is None else df.filter(self.member(key))

    def gate(self, metric: Metric, value: Column) -> Column:
        key = self._key(metric)
        return F.when(self.member(key), value) if self.several and key is not None else value

    def rows_name(self, metric: Metric) -> str:
        return f"r{self.source_sets.index(self._key(metric))}"

    def parts(self) -> dict[str, Part]:
        """Every additive partial, by column name."""
        found: dict[str, Part] = {}
        for i, m in enumerate(self.metrics):
            if isinstance(m, Additive):
                for name, part in m.parts.items():
                    found[f"p{i}_{name}"] = Part(self.gate(m, part.value), part.merge)
        if self.needs_rows:
            for i, key in enumerate(self.source_sets):
                one = F.when(self.member(key), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
                found[f"r{i}"] = Part(one)
        if not found:
            found["r"] = Part(F.lit(1).cast("bigint"))
        return found

    def partials(self) -> list[Column]:
        """Aggregates of rows that can be merged."""
        columns = [part.start().alias(name) for name, part in self.parts().items()]
        for i, state in self.moments.items():
            metric = self.metrics[i]
            columns += state.of_rows(*(self.gate(metric, c) for c in metric.inputs))
        return columns

    def row_aggregates(self) -> list[Column]:
        """Aggregates straight from rows: partials, then Spark's own."""
        columns = self.partials()
        for i, m in enumerate(self.metrics):
            if isinstance(m, Grouped):
                inputs = [self.gate(m, c) for c in m.inputs]
                columns.append(m.build(*inputs).alias(f"g{i}"))
        return columns

    def merged(self) -> list[Column]:
        """Aggregates that combine partials of smaller groups, moments aside."""
        return [part.combine(F.col(name)).alias(name) for name, part in self.parts().items()]

    def totals(self) -> list[Column]:
        return [
            F.coalesce(F.sum(f"r{i}"), F.lit(0)).alias(f"t{i}")
            for i in range(len(self.source_sets))
        ]

    def values(self, by_group: Column | None) -> list[Column]:
        """Final metric columns; ``by_group`` is true where empty means absent."""
        columns = []
        for i, m in enumerate(self.metrics):
            if isinstance(m, Additive):
                parts = {name: F.col(f"p{i}_{name}") for name in m.parts}
                if m.uses_total_size:
                    parts[TOTAL_SIZE] = F.col(f"t{self.source_sets.index(self._key(m))}")
                value = m.finish(parts)
            elif isinstance(m, Central):
                value = m.finish(self.moments[i].columns())
            elif isinstance(m, Grouped):
                value = F.col(f"g{i}")
            elif isinstance(m, Quantile):
                variable = self.variables.index((m.column, self._key(m)))
                of_variable = F.try_element_at(F.col(QUANTILES), F.lit(variable))
                value = F.get(of_variable, F.lit(self.asks.index(m.ask)))
            else:
                value = F.col(f"h{i}")
            value = m.scaled(value)
            if self.several and by_group is not None:
                value = F.when(~by_group | (F.col(self.rows_name(m)) > 0), value)
            columns.append(value.alias(m.name))
        return columns


def _quantile_maps(
    layout: _Layout,
    rows: DataFrame,
    dims: Sequence[str],
    levels: Sequence[Sequence[str]],
    expand: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """All quantiles of a summary: dimensions, level and variable -> quantiles.

    One sketch pass and two counting passes (one for few distinct values) serve
    every column, source set, fraction and level; levels roll up the counts.
    ``expand`` may send counts to several groups.
    """
    columns = list(dict.fromkeys(column for column, _ in layout.variables))
    numbers = rows.select(*(F.col(c).cast("double").alias(c) for c in columns))
    sketched = sketch_columns(numbers, columns)
    sketches = [sketched[column] for column, _ in layout.variables]
    limit = min(m.limit for m in layout.quantiles)
    values = [
        F.col(column) if key is None else F.when(layout.member(key), F.col(column))
        for column, key in layout.variables
    ]
    numbered = {level_number(dims, level): level for level in levels}
    found = level_quantiles(rows, dims, values, layout.asks, sketches, limit, numbered, expand)
    # One entry per variable.
    entries = F.collect_list(F.struct("variable", "quantiles"))
    maps = found.groupBy(*dims, LEVEL).agg(F.map_from_entries(entries).alias(QUANTILES))
    return maps.withColumn(LEVEL, F.col(LEVEL).cast("bigint"))


def _merged_levels(
    layout: _Layout, finest: DataFrame, dims: Sequence[str], levels: Sequence[Sequence[str]]
) -> DataFrame:
    """Levels of a summary with moments, from its finest groups; each goes to every level once."""

    def masked(level: Sequence[str]) -> Column:
        kept = [
            (F.col(d) if d in level else F.lit(None).cast(finest.schema[d].dataType)).alias(d)
            for d in dims
        ]
        return F.struct(*kept, F.lit(level_number(dims, level)).cast("bigint").alias(LEVEL))

    partials = [c for c in finest.columns if c not in dims]
    spread = finest.select(
        F.explode(F.array(*(masked(level) for level in levels))).alias("__to__"),
        F.pmod(F.xxhash64(*dims), F.lit(SALTS)).alias(_SALT),
        *partials,
    )
    spread = spread.select("__to__.*", _SALT, *partials)
    return merge(spread, [*dims, LEVEL], list(layout.moments.values()), layout.merged(), _SALT)


def summarize_levels(
    df: DataFrame,
    dims: Sequence[str],
    levels: Sequence[Sequence[str]],
    metrics: Sequence[Metric],
) -> DataFrame:
    """Metrics for several sets of grouping columns at once.

    Returns the dimensions, ``__level__`` (the grouping id, which tells a
    rolled-up dimension from a null value) and one column per metric. Additive
    metrics read the data once at the finest level and roll up that small table.
    """
    dims = list(dims)
    levels = [list(level) for level in dict.fromkeys(tuple(level) for level in levels)]
    layout = _Layout(metrics)
    rows = layout.restrict(df)
    whole = level_number(dims, [])
    single = levels[0] if len(levels) == 1 else None

    finest = None
    if single is not None:
        aggregated = rows.groupBy(*single).agg(*layout.row_aggregates())
        for d in dims:
            if d not in single:
                aggregated = aggregated.withColumn(d, F.lit(None).cast(df.schema[d].dataType))
        result = aggregated.withColumn(LEVEL, F.lit(level_number(dims, single)).cast("bigint"))
    elif layout.grouped:
        result = rows.groupingSets(levels, *dims).agg(
            F.grouping_id().alias(LEVEL), *layout.row_aggregates()
        )
    else:
        finest = rows.groupBy(*dims).agg(*layout.row_aggregates())
        if layout.moments:
            result = _merged_levels(layout, finest, dims, levels)
        else:
            result = finest.groupingSets(levels, *dims).agg(
                F.grouping_id().alias(LEVEL), *layout.merged()
            )

    if any(isinstance(m, Additive) and m.uses_total_size for m in metrics):
        counted = finest if finest is not None else rows.agg(*layout.row_aggregates())
        # One row of counts.
        result = result.crossJoin(F.broadcast(counted.agg(*layout.totals())))

    if layout.quantiles:
        maps = _quantile_maps(layout, rows, dims, levels)
        result = null_safe_join(result, maps, [*dims, LEVEL], "left")
    for i, m in enumerate(layout.metrics):
        if not isinstance(m, Holistic):
            continue
        seen = layout.visible(df, m)
        if m.at_levels is not None and single is None:
            values = m.at_levels(seen, dims, levels)
        else:
            pieces = [rolled_up(m.plan(seen, level), df, dims, level, "value") for level in levels]
            values = reduce(DataFrame.unionByName, pieces)
        values = values.withColumnRenamed("value", f"h{i}")
        result = null_safe_join(result, values, [*dims, LEVEL], "left")

    by_group = F.col(LEVEL) != whole if dims else None
    return result.select(*dims, LEVEL, *layout.values(by_group))


def summarize(
    df: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    with_columns: Mapping[str, Column | str] | None = None,
    drop_null_keys: bool | None = None,
) -> DataFrame:
    """Filter, derive columns, group once and evaluate every metric.

    Metrics over different sources share the scan. Null keys form a group of
    their own; with several source sets, rows whose keys are all null are
    dropped unless ``drop_null_keys`` says otherwise. Without keys the result
    is one row.
    """
    keys = list(keys)
    base = prepare(df, where, with_columns)
    if not metrics:
        return base.select(*keys).limit(0)
    result = summarize_levels(base, keys, [keys], metrics).drop(LEVEL)
    if drop_null_keys is None:
        drop_null_keys = _Layout(metrics).several
    if keys and drop_null_keys:
        result = result.filter(reduce(or_, (F.col(k).isNotNull() for k in keys)))
    return result


def join_summaries(
    summaries: Sequence[DataFrame], keys: Sequence[str], drop_null_keys: bool = True
) -> DataFrame:
    """Summaries made separately, side by side: null-safe full outer join on keys."""
    keys = list(keys)
    joined = reduce(lambda a, b: null_safe_join(a, b, keys, "full"), summaries)
    if keys and drop_null_keys:
        joined = joined.filter(reduce(or_, (F.col(k).isNotNull() for k in keys)))
    return joined


def ordered_frame(df: DataFrame, key: str, groups: Sequence[Any], ordinal: str) -> DataFrame:
    """The ordered groups as a table of their own."""
    schema = StructType(
        [StructField(ordinal, IntegerType()), StructField(key, df.schema[key].dataType)]
    )
    return df.sparkSession.createDataFrame([(i, g) for i, g in enumerate(groups)], schema)


def cumulative(
    df: DataFrame,
    key: str,
    ordered_groups: Sequence[Any],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    with_columns: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Metrics over all rows in the groups up to and including each one.

    Every listed group gets a row, also when no row falls into it or before it.
    Additive metrics, moments, modes and quantiles merge what each group has;
    autocorrelations look at every row once. Other aggregates see each row once
    per group that includes it, ahead of the partial aggregate of the same task.
    """
    base = prepare(df, where, with_columns)
    groups = list(ordered_groups)
    if not metrics or not groups:
        return base.select(key).limit(0)
    layout = _Layout(metrics)
    rows = layout.restrict(base)
    # One reference to the key: a CASE would repeat the expression behind it.
    at = F.array_position(F.lit(groups), F.col(key))
    ordinal = F.nullif(at, F.lit(0)).cast("int") - 1
    placed = rows.withColumn(_REACH, ordinal)
    # One row per group, sent to every group that includes it; behind the last one stands the
    # whole table, with the rows of no group.
    last = len(groups)
    listed = ordered_frame(base, key, [*groups, None], _REACH)
    per_group = placed.groupBy(_REACH).agg(*layout.partials())
    reach = F.sequence(F.coalesce(F.col(_REACH), F.lit(last)), F.lit(last))
    per_group = per_group.withColumn(_REACH, F.explode(reach))
    merged = merge(per_group, [_REACH], list(layout.moments.values()), layout.merged())
    result = listed.join(merged, _REACH, "left")
    if any(isinstance(m, Additive) and m.uses_total_size for m in metrics):
        whole = Window.partitionBy()  # as many rows as there are groups
        for i in range(len(layout.source_sets)):
            size = F.max(F.when(F.col(_REACH) == last, F.col(f"r{i}"))).over(whole)
            result = result.withColumn(f"t{i}", F.coalesce(size, F.lit(0)))
    result = result.filter(F.col(_REACH) < last)

    in_groups = placed.filter(F.col(_REACH).isNotNull())
    reaching = F.explode(F.sequence(F.col(_REACH), F.lit(last - 1)))
    if layout.grouped:
        expanded = in_groups.withColumn(_REACH, reaching)
        columns = [
            m.build(*(layout.gate(m, c) for c in m.inputs)).alias(f"g{i}")
            for i, m in enumerate(layout.metrics)
            if isinstance(m, Grouped)
        ]
        result = result.join(expanded.groupBy(_REACH).agg(*columns), _REACH, "left")
    if layout.quantiles:
        maps = _quantile_maps(
            layout,
            in_groups,
            [_REACH],
            [[_REACH]],
            lambda counts: counts.withColumn(_REACH, reaching),
        )
        result = result.join(maps.drop(LEVEL), _REACH, "left")
    for i, m in enumerate(layout.metrics):
        if isinstance(m, Holistic):
            seen = layout.visible(in_groups, m)
            if m.running_plan is not None:
                found = m.running_plan(seen, _REACH, last)
            else:
                found = m.plan(seen.withColumn(_REACH, reaching), [_REACH])
            result = result.join(found.withColumnRenamed("value", f"h{i}"), _REACH, "left")
    return result.select(key, *layout.values(None))

