"""Grids: how a second variable moves rows from their parent segment to a target.

A grid table has one row per band and parent segment:
``band_id, parent_id, target_id``. It holds bands x segments rows, so windows
over it and bringing it to the driver are bounded by configuration.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.functions.labels import label_codes
from bandwise.functions.predicates import first_match
from bandwise.operators.bands import Band, assign
from bandwise.operators.bounded import bounded_rows
from bandwise.operators.loss_bands import LossRate
from bandwise.operators.segments import Segment

Grid = Mapping[tuple[int, int], int]
SCHEMA = "band_id int, parent_id int, target_id int"


def grid_frame(spark: SparkSession, grid: Grid) -> DataFrame:
    return spark.createDataFrame([(b, p, t) for (b, p), t in grid.items()], SCHEMA)


def collect_grid(frame: DataFrame) -> dict[tuple[int, int], int]:
    """A grid table as driver-side configuration."""
    rows = bounded_rows(frame.select("band_id", "parent_id", "target_id"))
    return {(b, p): t for b, p, t in rows}


def target_of(band: Column, parent: Column, grid: Grid) -> Column:
    """Target segment of a band and parent: one lookup in a literal table.

    Ids are small numbers, so the table is an array of arrays; ids outside it
    and cells missing from the grid give null. Each argument is used once.
    """
    if not grid:
        return F.lit(None).cast("int")
    bands, parents = ([ids[i] for ids in grid] for i in (0, 1))
    first_band, first_parent = min(bands), min(parents)
    rows = [
        F.array(
            *(F.lit(grid.get((b, p))).cast("int") for p in range(first_parent, max(parents) + 1))
        )
        for b in range(first_band, max(bands) + 1)
    ]
    return F.get(F.get(F.array(*rows), band - first_band), parent - first_parent)


def assign_grid(
    value: Column,
    parent: Column,
    bands: Sequence[Band],
    grid: Grid,
    disabled: Collection[int] = (),
) -> Column:
    """Target segment of a value and its parent segment.

    Bands that are disabled or missing from the grid leave their rows unassigned.
    """
    in_grid = {b for b, _ in grid}
    active = [b for b in bands if b.id not in disabled and b.id in in_grid]
    return target_of(assign(value, active), parent, grid)


def join_grid(df: DataFrame, band: str, parent: str, grid: DataFrame, out: str) -> DataFrame:
    """Target segment by left join with the grid table; its size is left to the planner."""
    table = grid.select(
        F.col("band_id").alias("__b__"),
        F.col("parent_id").alias("__p__"),
        F.col("target_id").alias(out),
    )
    on = (F.col(band) == F.col("__b__")) & (F.col(parent) == F.col("__p__"))
    return df.join(table, on, "left").drop("__b__", "__p__")


def identity_grid(bands: DataFrame, segments: DataFrame) -> DataFrame:
    """Every row keeps its parent segment, in every band."""
    return bands.select("band_id").crossJoin(
        segments.select(
            F.col("segment_id").alias("parent_id"), F.col("segment_id").alias("target_id")
        )
    )


def assign_targets(
    cells: DataFrame,
    bands: DataFrame,
    segments: Sequence[Segment],
    loss: LossRate,
    upgrade: int,
    downgrade: int,
    rate: str = "rate",
) -> DataFrame:
    """Target of each grid cell by its observed loss rate.

    ``cells`` holds ``band_id, parent_id`` and the rate. The first segment
    within reach whose limit the scaled rate stays below is taken, else the
    last one within reach; a cell without data keeps its parent. Here the scale
    factor is floored at 1.
    """
    parents = bands.sparkSession.createDataFrame([(s.id,) for s in segments], "parent_id int")
    rates = cells.select("band_id", "parent_id", F.col(rate).alias("__rate__"))
    rectangle = bands.select("band_id").crossJoin(parents)
    full = rectangle.join(rates, ["band_id", "parent_id"], "left")
    known = F.col("__rate__").isNotNull() & ~F.isnan("__rate__")
    choices = []
    for i, parent in enumerate(segments):
        reach = list(segments[max(0, i - upgrade) : i + downgrade + 1])
        fits = (
            (F.col("__rate__") * F.lit(_floored(loss, s)) < F.lit(s.upper_rate), F.lit(s.id))
            for s in reach
        )
        choices.append(
            (known & (F.col("parent_id") == parent.id), first_match(fits, F.lit(reach[-1].id)))
        )
    target = first_match(choices, F.col("parent_id"))
    return full.select("band_id", "parent_id", target.alias("target_id"))


def _floored(loss: LossRate, segment: Segment) -> float:
    return max(loss.factor(segment), 1.0) if loss.use_scalar else 1.0


def _signatures(grid: DataFrame) -> DataFrame:
    """The targets of each band in parent order, as one array per band."""
    entry = F.struct("parent_id", "target_id")
    row = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.target_id)
    return grid.groupBy("band_id").agg(row.alias("targets"))


def _unfold(merged: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid rows of the merged bands; ``merged`` maps old to new band ids."""
    return grid.join(merged, "band_id").select(
        F.col("new_id").alias("band_id"), "parent_id", "target_id"
    ).distinct()


def merge_equal_bands(bands: DataFrame, grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Join neighbouring numeric bands whose grid rows agree; renumber from 0."""
    order = Window.orderBy("band_id")
    rows = bands.join(_signatures(grid), "band_id", "left")
    differs = ~F.col("targets").eqNullSafe(F.lag("targets").over(order))
    starts = F.when(differs | (F.row_number().over(order) == 1), 1).otherwise(0)
    islands = rows.withColumn("__start__", starts).withColumn(
        "new_id",
        (F.sum("__start__").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"),
    )
    merged = islands.groupBy(F.col("new_id").alias("band_id")).agg(
        F.min("lower").alias("lower"), F.max("upper").alias("upper")
    )
    return merged, _unfold(islands.select("band_id", "new_id"), grid)


def merge_equal_categories(
    categories: DataFrame, grid: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Join category bands whose grid rows agree; order by grid row, renumber from 0."""
    ranked = _signatures(grid).withColumn(
        "new_id", (F.dense_rank().over(Window.orderBy("targets")) - 1).cast("int")
    )
    mapping = ranked.select("band_id", "new_id")
    merged = categories.join(mapping, "band_id").select(
        F.col("new_id").alias("band_id"), "category"
    )
    return merged, _unfold(mapping, grid)


def monotone_grid(grid: DataFrame) -> DataFrame:
    """Targets never improve to the right within a row, nor downwards in a column."""
    along = Window.partitionBy("band_id").orderBy("parent_id")
    down = Window.partitionBy("parent_id").orderBy("band_id")
    running = (Window.unboundedPreceding, Window.currentRow)
    right = grid.withColumn("target_id", F.max("target_id").over(along.rowsBetween(*running)))
    return right.withColumn("target_id", F.max("target_id").over(down.rowsBetween(*running)))


def describe_grid(
    grid: DataFrame, segments: Sequence[Segment], disabled: Collection[int] = ()
) -> DataFrame:
    """Grid with segment names: a row per enabled band, a column per parent segment."""
    names = {s.id: s.name for s in segments}
    shown = grid.filter(~F.col("band_id").isin(list(disabled))) if disabled else grid
    label = label_codes(F.col("target_id"), names)
    wide = (
        shown.withColumn("__label__", label)
        .groupBy("band_id")
        .pivot("parent_id", list(names))
        .agg(F.first("__label__"))
    )
    return wide.select("band_id", *(F.col(str(i)).alias(n) for i, n in names.items()))
