"""Profiles of single variables and the effect of filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.functions.labels import percentile_label
from bandwise.functions.predicates import Predicate, predicate
from bandwise.operators.outliers import non_mode_quantiles
from bandwise.operators.quantiles import MAP_LIMIT, column_quantiles

# Percentiles shown for a right-skewed, left-skewed and other variable.
UPPER_TAIL = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
LOWER_TAIL = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75]
BOTH_TAILS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
SKEW_LIMIT = 0.1


def _quantile_rows(
    df: DataFrame, column: str, fractions: Sequence[float], limit: int
) -> DataFrame:
    """``(fraction, value)`` of the values other than the mode."""
    _, found = non_mode_quantiles(df, [column], fractions, limit)[column]
    return df.sparkSession.createDataFrame(
        list(zip([float(q) for q in fractions], found)), "fraction double, value double"
    )


def distribution_profile(df: DataFrame, column: str, limit: int = MAP_LIMIT) -> DataFrame:
    """Percentiles on the side where the variable has its tail.

    Columns: ``fraction, value, percentile, value_text``.
    """
    skew = df.agg(F.skewness(column)).first()[0]
    fractions = BOTH_TAILS
    if skew is not None and skew > SKEW_LIMIT:
        fractions = UPPER_TAIL
    elif skew is not None and skew < -SKEW_LIMIT:
        fractions = LOWER_TAIL
    return _quantile_rows(df, column, fractions, limit).select(
        "fraction",
        "value",
        percentile_label(F.col("fraction")).alias("percentile"),
        F.format_string("%.2f", "value").alias("value_text"),
    )


def quantile_table(
    df: DataFrame, column: str, fractions: Sequence[float], limit: int = MAP_LIMIT
) -> DataFrame:
    """One row: ``variable``, then a column per wanted quantile in the order asked for.

    Fractions whose labels round to the same text keep a column each, also where the values are all null.
    """
    _, found = non_mode_quantiles(df, [column], fractions, limit)[column]
    row = df.sparkSession.range(1).select(F.lit(column).alias("variable"))
    values = [
        F.lit(v).cast("double").alias(f"{q * 100:.0f}th Percentile") for q, v in zip(fractions, found)
    ]
    return row.select("variable", *values)


def box_plot(df: DataFrame, column: str, limit: int = MAP_LIMIT) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, outliers beyond: one row.

    Without values, all but the counts are null.
    """
    q1, q2, q3 = column_quantiles(df, [column], [0.25, 0.5, 0.75], limit)[column]
    x = F.col(column).cast("double")
    inside = F.lit(None).cast("boolean")
    if q1 is not None:
        reach = 1.5 * (q3 - q1)
        inside = (x >= F.lit(q1 - reach)) & (x <= F.lit(q3 + reach))
    q1, q2, q3 = (F.lit(q).cast("double") for q in (q1, q2, q3))
    return df.agg(
        F.count(column).alias("n"),
        F.min(x).alias("minimum"),
        q1.alias("q1"),
        q2.alias("median"),
        q3.alias("q3"),
        F.max(x).alias("maximum"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def filter_impact(df: DataFrame, filters: Mapping[str, Predicate]) -> DataFrame:
    """Rows satisfying and failing each filter; null counts as neither. One pass."""
    columns, entries = [], []
    for i, (name, value) in enumerate(filters.items()):
        p = predicate(value)
        columns += [F.count_if(p).alias(f"y{i}"), F.count_if(~p).alias(f"n{i}")]
        entries.append(
            F.struct(
                F.lit(name).alias("filter"),
                F.col(f"y{i}").alias("satisfied"),
                F.col(f"n{i}").alias("failed"),
            )
        )
    return df.agg(*columns).select(F.inline(F.array(*entries)))
