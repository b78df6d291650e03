"""Risk segments: a small ordered table of names, rate limits and scale factors.

A segment table has the columns ``segment_id, name, lower_rate, upper_rate,
maf_dollar, maf_unit`` and one row per segment; its order is ``segment_id``.
It is configuration, so windows over all of it and bringing it to the driver
are bounded by the number of segments.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwise.functions.predicates import first_match
from bandwise.operators.bounded import bounded_rows

INF = float("inf")
DOLLAR = "dollar"
UNIT = "unit"

SCHEMA = (
    "segment_id int, name string, lower_rate double, upper_rate double, "
    "maf_dollar double, maf_unit double"
)

# The default segments (name, lower rate, upper rate, maturity factor).
DEFAULT_SEGMENTS = [
    ("1A", 0.00, 0.02, 1.3),
    ("1B", 0.00, 0.02, 1.3),
    ("2A", 0.02, 0.04, 1.15),
    ("2B", 0.02, 0.04, 1.15),
    ("3A", 0.04, 0.07, 1.0),
    ("3B", 0.04, 0.07, 1.0),
    ("4A", 0.07, 0.10, 0.9),
    ("4B", 0.07, 0.10, 0.9),
    ("5A", 0.10, INF, 0.8),
    ("5B", 0.10, INF, 0.8),
]


@dataclass(frozen=True)
class Segment:
    id: int
    name: str
    lower_rate: float
    upper_rate: float
    maf_dollar: float = 1.0
    maf_unit: float = 1.0

    def maf(self, rate_type: str) -> float:
        if rate_type not in (DOLLAR, UNIT):
            raise ValueError(f"unknown rate type {rate_type!r}")
        return self.maf_dollar if rate_type == DOLLAR else self.maf_unit


def default_segments() -> list[Segment]:
    return [Segment(i, n, lo, up, maf, maf) for i, (n, lo, up, maf) in enumerate(DEFAULT_SEGMENTS)]


def segment_frame(spark: SparkSession, segments: Sequence[Segment]) -> DataFrame:
    rows = [
        (s.id, s.name, *map(float, (s.lower_rate, s.upper_rate, s.maf_dollar, s.maf_unit)))
        for s in segments
    ]
    return spark.createDataFrame(rows, SCHEMA)


def collect_segments(frame: DataFrame) -> list[Segment]:
    """A segment table as driver-side configuration."""
    columns = ["segment_id", "name", "lower_rate", "upper_rate", "maf_dollar", "maf_unit"]
    return [Segment(*row) for row in bounded_rows(frame.select(*columns).orderBy("segment_id"))]


def portfolio_scalar(current_rate: float | None, lifetime_rate: float | None) -> float:
    """Lifetime over current loss rate; 1 when either is not set."""
    if current_rate is None or lifetime_rate is None or current_rate <= 0:
        return 1.0
    return lifetime_rate / current_rate


def scale_factor(maf: Column | float, scalar: float) -> Column:
    """Maturity factor times portfolio scalar, never below 1."""
    value = F.lit(maf) if isinstance(maf, (int, float)) else maf
    return F.greatest(value * F.lit(float(scalar)), F.lit(1.0))


def contiguous_lower_rates(segments: DataFrame) -> DataFrame:
    """Lower rate = upper rate of the previous segment; tied neighbours share theirs."""
    order = Window.orderBy("segment_id")
    previous = F.lag("upper_rate").over(order)
    starts = (F.col("upper_rate") != previous) | previous.isNull()
    lower = F.when(previous.isNull(), F.lit(0.0)).when(starts, previous)
    marked = segments.withColumn("__lower__", lower)
    filled = F.last("__lower__", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return marked.withColumn("lower_rate", filled).drop("__lower__")


def split_equal_rates(segments: DataFrame) -> DataFrame:
    """Segments sharing an upper rate divide their interval evenly.

    An unbounded interval is given the widest width among the earlier ones.
    """
    tied = Window.partitionBy("upper_rate")
    ranked = segments.select(
        "*",
        F.row_number().over(tied.orderBy("segment_id")).alias("__k__"),
        F.count(F.lit(1)).over(tied).alias("__m__"),
        F.min("lower_rate").over(tied).alias("__low__"),
        F.min("segment_id").over(tied).alias("__first__"),
    )
    order = Window.orderBy("__first__", "segment_id")
    width = F.col("upper_rate") - F.col("__low__")
    # Rows of the same interval share its width, so including them is harmless
    # except for the unbounded interval itself.
    earlier = F.max(F.when(width < INF, width)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    span = F.when(F.col("upper_rate") == INF, F.greatest(earlier, F.lit(0.0))).otherwise(width)
    placed = ranked.withColumn("__span__", F.coalesce(span, F.lit(0.0)))
    step = F.col("__span__") / F.col("__m__")
    end = F.when(F.col("upper_rate") < INF, F.col("upper_rate")).otherwise(
        F.col("__low__") + F.col("__span__")
    )
    top = F.when(F.col("__k__") == F.col("__m__"), end).otherwise(
        F.col("__low__") + step * F.col("__k__")
    )
    return (
        placed.withColumn("lower_rate", F.col("__low__") + step * (F.col("__k__") - 1))
        .withColumn("upper_rate", top)
        .select(*segments.columns)
    )


def segment_by_rate(rate: Column, segments: Sequence[Segment]) -> Column:
    """Name of the first segment with ``lower <= rate < upper``; null if none."""
    cases = (
        ((rate >= F.lit(s.lower_rate)) & (rate < F.lit(s.upper_rate)), F.lit(s.name))
        for s in segments
    )
    return first_match(cases, F.lit(None).cast("string"))


def scale_factor_table(segments: DataFrame, rate_type: str, scalar: float) -> DataFrame:
    """Per segment: maturity factor in percent and the scale factor it leads to."""
    maf = F.col("maf_dollar" if rate_type == DOLLAR else "maf_unit")
    return segments.select(
        "segment_id",
        "name",
        (maf * 100).alias("maf_percent"),
        scale_factor(maf, scalar).alias("scale_factor"),
    )


def scale_rates(
    df: DataFrame, column: str, segment: str, segments: DataFrame, rate_type: str, scalar: float
) -> DataFrame:
    """Multiply a rate by the scale factor of the row's segment.

    Rows without a known segment (totals) use a maturity factor of 1. The
    segment table is the caller's, so its size is left to the planner.
    """
    factors = segments.select(
        F.col("segment_id").alias("__segment__"),
        F.col("maf_dollar" if rate_type == DOLLAR else "maf_unit").alias("__maf__"),
    )
    joined = df.join(factors, F.col(segment) == F.col("__segment__"), "left")
    factor = scale_factor(F.coalesce(F.col("__maf__"), F.lit(1.0)), scalar)
    return joined.withColumn(column, F.col(column) * factor).select(*df.columns)
