"""Building the steps of a chain from data: bands, grid, merging, in a few passes.

What comes back to the driver is configuration: bounds, categories and grid
cells. Everything after the cell rates works on those few rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.arithmetic import ratio
from bandwise.functions.predicates import Predicate, keep
from bandwise.operators.bands import (
    MAX_CATEGORIES,
    Band,
    assign,
    assign_lookup,
    bands_frame,
    check_variable,
    clip_outer_bounds,
    collect_bands,
    collect_categories,
    even_category_bands,
    numeric_range,
    quantile_bands,
)
from bandwise.operators.grid import (
    assign_targets,
    collect_grid,
    grid_frame,
    merge_equal_bands,
    merge_equal_categories,
    monotone_grid,
)
from bandwise.operators.loss_bands import (
    LossRate,
    ValueTable,
    loss_rate_bands,
    loss_rate_categories,
    table_bands,
)
from bandwise.operators.segments import (
    INF,
    Segment,
    collect_segments,
    segment_frame,
    split_equal_rates,
)
from bandwise.plans.chain import SEGMENT, Chain, Step, score
from bandwise.sources.union import NUMERICAL, kind_of

DEFAULT_CHILD_BANDS = 10
_CELLS = "band_id int, parent_id int, rate double"


def _distinct_limits(df: DataFrame, segments: Sequence[Segment]) -> list[Segment]:
    return collect_segments(split_equal_rates(segment_frame(df.sparkSession, segments)))


def _is_numeric(df: DataFrame, variable: str, max_categories: int | None) -> bool:
    numeric = variable in df.columns and kind_of(df.schema[variable].dataType) == NUMERICAL
    problems = check_variable(df, variable, numeric, max_categories)
    if problems:
        raise ValueError("; ".join(problems))
    return numeric


def _even_bands(df: DataFrame, variable: str, count: int, limit: int) -> list[Band]:
    return collect_categories(even_category_bands(df, variable, count), limit + count)


def _table_step(
    variable: str,
    categories: DataFrame,
    ids: Sequence[int],
    folder: str,
    grid: Mapping[tuple[int, int], int] | None = None,
) -> Step:
    """A step that holds its categories as a table below ``folder``."""
    path = f"{folder.rstrip('/')}/bands"
    found = categories.filter(F.col("category").isNotNull())
    found.select(F.col("band_id").cast("int").alias("band_id"), "category").write.parquet(path)
    bands = tuple(Band(i, categories=frozenset()) for i in ids)
    return Step(variable, bands, grid, categories_path=path)


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def _table_cells(rows: DataFrame, variable: str, table: DataFrame, loss: LossRate) -> DataFrame:
    """Rate of each (band, parent); rows are summed up by category before the table is joined."""
    below = F.sum(loss.denominator) if loss.denominator else F.count(F.lit(1))
    sums = rows.groupBy(F.col(variable).cast("string").alias("__value__"), "parent_id").agg(
        F.sum(loss.numerator).alias("__above__"), below.alias("__below__")
    )
    rate = ratio(F.coalesce(F.sum("__above__"), F.lit(0)), F.sum("__below__")) * loss.annual
    placed = assign_lookup(sums, "__value__", table, "band_id")
    return placed.groupBy("band_id", "parent_id").agg(rate.alias("rate"))


def _clipped(df: DataFrame, variable: str, bands: Sequence[Band], include_min: bool) -> list[Band]:
    """Outer bounds from the unfiltered range."""
    found = numeric_range(df, [variable]).first()
    return clip_outer_bounds(bands, found["minimum"], found["maximum"], include_min)


def root_step(
    df: DataFrame,
    variable: str,
    segments: Sequence[Segment],
    loss: LossRate | None = None,
    where: Predicate | None = None,
    high_is_risky: bool | None = None,
    include_min: bool = True,
    max_categories: int = MAX_CATEGORIES,
    categories_folder: str | None = None,
) -> Step:
    """First step of a chain: one band per segment.

    With a loss rate, bands follow the observed losses of the filtered rows;
    without, they split the variable evenly. Categories are listed in the step,
    at most ``max_categories``, or go to a table in the new ``categories_folder``,
    which holds any number of them and has to stay as long as the step is used.
    """
    if not any(s.upper_rate < INF for s in segments):
        raise ValueError("at least one segment needs a finite upper rate")
    numeric = _is_numeric(df, variable, None if categories_folder else max_categories)
    if loss is None:
        if numeric:
            bands = quantile_bands(df, variable, len(segments))
        elif categories_folder:
            chunks = even_category_bands(df, variable, len(segments))
            ids = [s.id for s in segments]
            named = chunks.withColumn("band_id", F.get(F.lit(ids), "band_id"))
            return _table_step(variable, named, ids, categories_folder)
        else:
            bands = _even_bands(df, variable, len(segments), max_categories)
        bands = [replace(b, id=s.id) for b, s in zip(bands, segments)]
        return Step(variable, tuple(bands))
    rows, limits = keep(df, where), _distinct_limits(df, segments)
    if numeric:
        found = loss_rate_bands(rows, variable, limits, loss, high_is_risky)
        return Step(variable, tuple(_clipped(df, variable, found, include_min)))
    found = loss_rate_categories(rows, variable, limits, loss)
    if categories_folder:
        return _table_step(variable, found, [s.id for s in segments], categories_folder)
    members = {b.id: b for b in collect_categories(found, max_categories)}
    empty = frozenset()
    return Step(
        variable, tuple(members.get(s.id, Band(s.id, categories=empty)) for s in segments)
    )


def child_step(
    df: DataFrame,
    chain: Chain,
    variable: str,
    segments: Sequence[Segment],
    loss: LossRate | None = None,
    upgrade: int = 1,
    downgrade: int = 1,
    monotone: bool = False,
    where: Predicate | None = None,
    high_is_risky: bool | None = None,
    include_min: bool = True,
    max_categories: int = MAX_CATEGORIES,
    categories_folder: str | None = None,
) -> Step:
    """A further step: the variable's bands and the grid from parent to target segment.

    Without a loss rate, ten even bands that change nothing. Categories are listed
    or go to a table in ``categories_folder``, as in the first step.
    """
    numeric = _is_numeric(df, variable, None if categories_folder else max_categories)
    if loss is None:
        if numeric:
            bands = quantile_bands(df, variable, DEFAULT_CHILD_BANDS)
        elif categories_folder:
            chunks = even_category_bands(df, variable, DEFAULT_CHILD_BANDS)
            ids = range(DEFAULT_CHILD_BANDS)
            grid = {(i, s.id): s.id for i in ids for s in segments}
            return _table_step(variable, chunks, ids, categories_folder, grid)
        else:
            bands = _even_bands(df, variable, DEFAULT_CHILD_BANDS, max_categories)
        grid = {(b.id, s.id): s.id for b in bands for s in segments}
        return Step(variable, tuple(bands), grid)

    spark, limits = df.sparkSession, _distinct_limits(df, segments)
    rows = score(keep(df, where), chain).withColumnRenamed(SEGMENT, "parent_id")
    if numeric:
        with ValueTable(rows, variable, loss, ["parent_id"]) as table:
            found = table_bands(table, limits, upgrade, downgrade, high_is_risky)
            bands = _clipped(df, variable, found, include_min)
            # Bands x segments rows.
            cells = spark.createDataFrame(table.cell_rates(bands).collect(), _CELLS)
    elif categories_folder:
        # Written once: cells, merged bands and scoring all read it.
        table = _written(
            loss_rate_categories(rows, variable, limits, loss),
            f"{categories_folder.rstrip('/')}/by_rate",
        )
        bands = [Band(s.id, categories=frozenset()) for s in limits]
        cells = _table_cells(rows, variable, table, loss)
    else:
        listed = collect_categories(
            loss_rate_categories(rows, variable, limits, loss), max_categories
        )
        members = {b.id: b for b in listed}
        bands = [members.get(s.id, Band(s.id, categories=frozenset())) for s in limits]
        below = F.sum(loss.denominator) if loss.denominator else F.count(F.lit(1))
        rate = ratio(F.coalesce(F.sum(loss.numerator), F.lit(0)), below) * loss.annual
        cells = (
            rows.withColumn("band_id", assign(F.col(variable), bands))
            .groupBy("band_id", "parent_id")
            .agg(rate.alias("rate"))
        )
    ids = spark.createDataFrame([(b.id,) for b in bands], "band_id int")
    targets = assign_targets(cells, ids, limits, loss, upgrade, downgrade)
    # From here on only the grid itself, bands x segments rows.
    grid = grid_frame(spark, collect_grid(targets))
    if numeric:
        merged, grid = merge_equal_bands(bands_frame(spark, bands), grid)
        final = collect_bands(merged)
    elif categories_folder:
        merged, grid = merge_equal_categories(table, grid)
        if monotone:
            grid = monotone_grid(grid)
        cells = collect_grid(grid)
        ids = sorted({band for band, _ in cells})
        return _table_step(variable, merged, ids, categories_folder, cells)
    else:
        listed = [(b.id, c) for b in bands for c in (sorted(b.categories) or [None])]
        table = spark.createDataFrame(listed, "band_id int, category string")
        merged, grid = merge_equal_categories(table, grid)
        final = collect_categories(merged, max_categories + len(bands))
    if monotone:
        grid = monotone_grid(grid)
    return Step(variable, tuple(final), collect_grid(grid))
