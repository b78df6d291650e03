"""Report tables over a scored frame: segments, grid cells, pivots, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.functions.labels import label_codes
from bandwise.functions.predicates import Predicate, first_match
from bandwise.operators.grid import target_of
from bandwise.operators.metrics import Metric
from bandwise.operators.ordering import null_safe_join
from bandwise.operators.segments import DOLLAR, UNIT, Segment, scale_factor
from bandwise.operators.summarize import LEVEL, cumulative, prepare, summarize_levels
from bandwise.plans.chain import SEGMENT, Chain, score

TOTAL = "Total"

# Headers of a wide pivot.
NULL, SEPARATOR, QUOTE = "null", " | ", '"'

# Columns of a comparison while it is made; the input may use the names it ends with.
CHAIN, POSITION, MEMBER, NAME = "__chain__", "__position__", "__member__", "__name__"


class Scaling:
    """Which metrics are loss rates to be scaled to lifetime, and by what."""

    def __init__(
        self, dollar: Mapping[str, float] | None = None, unit: Mapping[str, float] | None = None
    ):
        """Metric name to portfolio scalar, per rate type."""
        self.scalars = {
            **{name: (DOLLAR, s) for name, s in (dollar or {}).items()},
            **{name: (UNIT, s) for name, s in (unit or {}).items()},
        }

    def apply(self, metric: str, value: Column, segment: Column, segments: Sequence[Segment]):
        """Value times the factor of its segment; maturity factor 1 without one."""
        if metric not in self.scalars:
            return value
        rate_type, scalar = self.scalars[metric]
        factors = ((segment == s.id, F.lit(float(s.maf(rate_type)))) for s in segments)
        maf = first_match(factors, F.lit(1.0))
        return value * scale_factor(maf, scalar)


def formatted(df: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """Metric columns as display text; the last step of a report."""
    by_name = {m.name: m for m in metrics}
    return df.select(
        *(by_name[c].shown(F.col(c)).alias(c) if c in by_name else F.col(c) for c in df.columns)
    )


def segment_table(
    df: DataFrame,
    chain: Chain,
    segments: Sequence[Segment],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    total: bool = True,
    scaling: Scaling | None = None,
) -> DataFrame:
    """Metrics per final segment, every segment present and in order.

    Columns: ``position, segment_id, name`` and the metrics. The total row
    covers all filtered rows, including those outside every segment.
    """
    scored = score(prepare(df, where), chain)
    # Config-sized: the segments, and a total.
    listed = [(i, s.id, s.name, 0) for i, s in enumerate(segments)]
    if total:
        listed.append((len(segments), None, TOTAL, 1))
    result = df.sparkSession.createDataFrame(
        listed, f"position int, {SEGMENT} int, name string, {LEVEL} bigint"
    )
    running = [m for m in metrics if m.cumulative]
    # The total of a cumulative metric is the metric over all rows.
    direct = list(metrics) if total else [m for m in metrics if not m.cumulative]
    if direct:
        levels = [[SEGMENT], []] if total else [[SEGMENT]]
        found = summarize_levels(scored, [SEGMENT], levels, direct)
        result = null_safe_join(result, found, [SEGMENT, LEVEL], "left")
    if running:
        upto = cumulative(scored, SEGMENT, [s.id for s in segments], running)
        renamed = upto.withColumnsRenamed({m.name: f"__upto__{m.name}" for m in running})
        result = result.join(renamed, SEGMENT, "left")
        for m in running:
            value = F.col(f"__upto__{m.name}")
            if total:
                value = F.when(F.col(LEVEL) == 1, F.col(m.name)).otherwise(value)
            result = result.withColumn(m.name, value)
    return result.select(
        "position",
        F.col(SEGMENT).alias("segment_id"),
        "name",
        *_scaled(metrics, F.col(SEGMENT), segments, scaling),
    )


def _scaled(
    metrics: Sequence[Metric],
    segment: Column,
    segments: Sequence[Segment],
    scaling: Scaling | None,
) -> list[Column]:
    if scaling is None:
        return [F.col(m.name) for m in metrics]
    return [
        scaling.apply(m.name, F.col(m.name), segment, segments).alias(m.name) for m in metrics
    ]


def _refuse_cumulative(metrics: Sequence[Metric]) -> None:
    running = [m.name for m in metrics if m.cumulative]
    if running:
        raise ValueError(f"cumulative metrics need ordered segments: {', '.join(running)}")


def cell_table(
    df: DataFrame,
    chain: Chain,
    segments: Sequence[Segment],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    total_row: bool = True,
    total_column: bool = True,
    scaling: Scaling | None = None,
) -> DataFrame:
    """Metrics per band of the last step and parent segment: the full rectangle.

    Columns: ``band_id, parent_id, total_row, total_column`` and the metrics;
    a total has a null id. Cells scale by their target segment, the total row
    by the parent, the total column not by segment.
    """
    last = chain[-1]
    if last.grid is None:
        raise ValueError("the chain has a single step")
    _refuse_cumulative(metrics)
    base = score(prepare(df, where), chain[:-1], "__parent__")
    rows = last.with_band(base, "band_id").withColumnRenamed("__parent__", "parent_id")
    dims = ["band_id", "parent_id"]
    levels = [dims]
    if total_column:
        levels.append(["band_id"])
    if total_row:
        levels.append(["parent_id"])
    if total_row and total_column:
        levels.append([])
    found = summarize_levels(rows, dims, levels, metrics)

    spark = df.sparkSession
    # Config-sized: bands x segments, plus the totals.
    bands = [(b.id, False) for b in last.bands if b.id not in last.disabled]
    parents = [(s.id, False) for s in segments]
    if total_row:
        bands.append((None, True))
    if total_column:
        parents.append((None, True))
    rectangle = spark.createDataFrame(bands, "band_id int, total_row boolean").crossJoin(
        spark.createDataFrame(parents, "parent_id int, total_column boolean")
    )
    bits = F.when(F.col("total_row"), 2).otherwise(0) + F.when(F.col("total_column"), 1).otherwise(0)
    found = found.withColumnsRenamed({"band_id": "__b__", "parent_id": "__p__"})
    same = [
        bits == F.col(LEVEL),
        F.col("band_id").eqNullSafe(F.col("__b__")),
        F.col("parent_id").eqNullSafe(F.col("__p__")),
    ]
    joined = rectangle.join(found, reduce(and_, same), "left")
    target = F.coalesce(
        target_of(F.col("band_id"), F.col("parent_id"), last.grid), F.col("parent_id")
    )
    segment = F.when(F.col("total_column"), F.lit(None)).when(
        F.col("total_row"), F.col("parent_id")
    ).otherwise(target)
    return joined.select(
        "band_id", "parent_id", "total_row", "total_column",
        *_scaled(metrics, segment, segments, scaling),
    )


def cell_grid(cells: DataFrame, metric: str, segments: Sequence[Segment]) -> DataFrame:
    """One metric of ``cell_table`` as a grid: bands down, parent segments across."""
    names = [s.name for s in segments]
    label = F.when(F.col("total_column"), F.lit(TOTAL)).otherwise(
        label_codes(F.col("parent_id"), {s.id: s.name for s in segments})
    )
    return (
        cells.withColumn("__label__", label)
        .groupBy("total_row", "band_id")
        .pivot("__label__", [*names, TOTAL])
        .agg(F.first(metric))
    )


def pivot_long(
    df: DataFrame,
    rows: Sequence[str],
    columns: Sequence[str],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    with_columns: Mapping[str, Column | str] | None = None,
) -> DataFrame:
    """Metrics for every prefix of rows crossed with every prefix of columns.

    Dimensions come out as text with ``Total`` where rolled up; a null value
    stays null. ``__level__`` tells a real value ``Total`` from a subtotal.
    """
    if not rows:
        raise ValueError("a pivot needs at least one row dimension")
    _refuse_cumulative(metrics)
    base = prepare(df, where, with_columns)
    dims = [*rows, *columns]
    levels = [
        [*rows[:r], *columns[:c]] for r in range(len(rows), -1, -1) for c in range(len(columns), -1, -1)
    ]
    found = summarize_levels(base, dims, levels, metrics)
    labels = [
        F.when(F.col(LEVEL).bitwiseAND(1 << (len(dims) - 1 - i)) != 0, F.lit(TOTAL))
        .otherwise(F.col(d).cast("string"))
        .alias(d)
        for i, d in enumerate(dims)
    ]
    return found.select(*labels, LEVEL, *(m.name for m in metrics))


def _header(label: Column, rolled_up: Column) -> Column:
    """Text of one dimension of a header; values that could be taken for something else are quoted."""
    unclear = label.isin(TOTAL, NULL) | label.contains(SEPARATOR) | label.startswith(QUOTE)
    quoted = F.concat(F.lit(QUOTE), F.replace(label, F.lit(QUOTE), F.lit(QUOTE * 2)), F.lit(QUOTE))
    shown = F.when(unclear, quoted).otherwise(label)
    return F.when(rolled_up, F.lit(TOTAL)).otherwise(F.coalesce(shown, F.lit(NULL)))


def pivot_wide(
    long: DataFrame, rows: Sequence[str], columns: Sequence[str], metric: str,
    headers: Sequence[str] | None = None, row_level: str | None = None, most_headers: int = 1000,
) -> DataFrame:
    """One metric of ``pivot_long`` with the column dimensions across, totals last.

    A header joins the labels of its dimensions by `` | ``; values that read
    ``Total`` or ``null``, hold the separator or start with a quote stand in
    double quotes, so no value falls together with a total or a missing one.
    ``headers`` fixes the columns; otherwise they are read first, and more than
    ``most_headers`` are refused. Rows of a value ``Total`` and of a total stay
    apart; ``row_level`` names a column that tells which is which (0: no total).
    """
    level = F.shiftright(LEVEL, len(columns))
    kept = [*rows, level.alias(row_level)] if row_level else list(rows)
    if not columns:
        return long.select(*kept, metric)
    totals = [
        F.col(LEVEL).bitwiseAND(1 << (len(columns) - 1 - i)) != 0 for i in range(len(columns))
    ]
    parts = [_header(F.col(c), rolled_up) for c, rolled_up in zip(columns, totals)]
    headed = long.select(
        *rows, level.alias(LEVEL), F.concat_ws(SEPARATOR, *parts).alias("__head__"),
        F.array(*totals).alias("__totals__"), F.array(*columns).alias("__labels__"),
        F.col(metric).alias("__value__"),
    )
    if headers is None:
        distinct = headed.select("__head__", "__totals__", "__labels__").distinct()
        found = distinct.limit(most_headers + 1).collect()
        if len(found) > most_headers:
            raise ValueError(f"a pivot with more than {most_headers} columns")
        found.sort(key=lambda r: [(t, str(v)) for t, v in zip(r["__totals__"], r["__labels__"])])
        headers = [r["__head__"] for r in found]
    wide = headed.groupBy(*rows, LEVEL).pivot("__head__", list(headers)).agg(F.first("__value__", ignorenulls=True))
    return wide.withColumnRenamed(LEVEL, row_level) if row_level else wide.drop(LEVEL)


def dimension_candidates(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """Columns with at most ``limit`` distinct values, null counting as one.

    A sketch rules out the many-valued columns: up to a few hundred values its
    estimate is a count of distinct hashes, so it cannot exceed ``limit`` by
    much. Only the rest is counted exactly, all columns in one pass.
    """
    estimates = df.agg(
        *(F.approx_count_distinct(F.col(c)).alias(f"n{i}") for i, c in enumerate(columns))
    ).first()
    estimates = dict(zip(columns, estimates))
    few = [c for c in columns if estimates[c] <= 2 * limit]
    if not few:
        return df.sparkSession.createDataFrame([], "variable string, n_unique bigint")
    counts = df.agg(
        *(
            (F.count_distinct(F.col(c)) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0)))
            .alias(f"n{i}")
            for i, c in enumerate(few)
        )
    )
    entries = [
        F.struct(F.lit(c).alias("variable"), F.col(f"n{i}").alias("n_unique"))
        for i, c in enumerate(few)
    ]
    return counts.select(F.inline(F.array(*entries))).filter(F.col("n_unique") <= limit)


def segment_dimension(df: DataFrame, chain: Chain, segments: Sequence[Segment], out: str) -> DataFrame:
    """Name of the final segment as a column to pivot by."""
    scored = score(df, chain, "__dim__")
    named = scored.withColumn(
        out, label_codes(F.col("__dim__"), {s.id: s.name for s in segments})
    )
    return named.select(*df.columns, out)


def compare_chains(
    df: DataFrame,
    chains: Mapping[str, tuple[Chain, Sequence[Segment]]],
    metrics: Sequence[Metric],
    where: Predicate | None = None,
    total: bool = False,
    scaling: Scaling | None = None,
) -> DataFrame:
    """Metrics per segment of several chains side by side, as ``segment_table`` gives them.

    Columns: ``chain, position, segment_id, name``, metrics. Metrics of a
    segment's own rows take one scan: every row is scored by all chains and
    repeated once per chain before the partial aggregation. Cumulative metrics
    and shares of the total size need the table of each chain, one scan each.
    """
    if not chains:
        raise ValueError("no chains to compare")
    rows = prepare(df, where)
    listed = []
    for name, (_, segments) in chains.items():
        listed += [(name, i, s.id, s.name, 0) for i, s in enumerate(segments)]
        if total:
            listed.append((name, len(segments), None, TOTAL, 1))
    # Config-sized: the segments of each chain, and a total.
    result = df.sparkSession.createDataFrame(
        listed, f"{CHAIN} string, {POSITION} int, {MEMBER} int, {NAME} string, {LEVEL} bigint"
    )

    apart = [m for m in metrics if m.cumulative or getattr(m, "uses_total_size", False)]
    shared = [m for m in metrics if m not in apart]
    if shared:
        scored, entries = rows, []
        for i, (name, (chain, _)) in enumerate(chains.items()):
            scored = score(scored, chain, f"__c{i}__")
            entries.append(F.struct(F.lit(name).alias(CHAIN), F.col(f"__c{i}__").alias(MEMBER)))
        repeated = scored.select(*rows.columns, F.inline(F.array(*entries)))
        levels = [[CHAIN, MEMBER], [CHAIN]] if total else [[CHAIN, MEMBER]]
        found = summarize_levels(repeated, [CHAIN, MEMBER], levels, shared)
        result = null_safe_join(result, found, [CHAIN, MEMBER, LEVEL], "left")
    if apart:
        tables = [
            segment_table(rows, chain, segments, apart, total=total).select(
                F.lit(name).alias(CHAIN), F.col("position").alias(POSITION), *(m.name for m in apart)
            )
            for name, (chain, segments) in chains.items()
        ]
        result = result.join(reduce(DataFrame.unionByName, tables), [CHAIN, POSITION], "left")

    # Every chain scales by its own segments.
    per_chain = [_scaled(metrics, F.col(MEMBER), segments, scaling) for _, segments in chains.values()]
    values = [
        first_match(((F.col(CHAIN) == c, v) for c, v in zip(chains, column)), F.lit(None)).alias(m.name)
        if scaling is not None and m.name in scaling.scalars
        else F.col(m.name)
        for m, column in zip(metrics, zip(*per_chain))
    ]
    return result.select(
        F.col(CHAIN).alias("chain"), F.col(POSITION).alias("position"),
        F.col(MEMBER).alias("segment_id"), F.col(NAME).alias("name"), *values,
    )


def to_wide(
    df: DataFrame, index: Sequence[str], header: str, value: str, headers: Sequence
) -> DataFrame:
    """Long to wide; listed headers appear in order, missing cells are null."""
    return df.groupBy(*index).pivot(header, list(headers)).agg(F.first(value))


def to_long(df: DataFrame, index: Sequence[str], header: str, value: str) -> DataFrame:
    """Wide to long."""
    measures = [c for c in df.columns if c not in index]
    return df.unpivot(list(index), measures, header, value)


def sorted_totals_last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Order by label with the total of each dimension after its values."""
    keys = [k for c in columns for k in (F.col(c).eqNullSafe(TOTAL), F.col(c).asc_nulls_first())]
    return df.orderBy(*keys)

