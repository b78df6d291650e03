"""Information Value: how well variables separate a binary target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from bandwise.functions.labels import strength_label
from bandwise.functions.predicates import Predicate, keep
from bandwise.operators.ordering import Sketch, bucket_of, read_sketches, sketch_aggregates
from bandwise.operators.quantiles import MAP_LIMIT, column_quantiles
from bandwise.plans.tables import dimension_candidates

BINS = 20
MAX_TEXT_VALUES = 10
FLOOR = 1e-6


def _is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NumericType)


def bin_edges(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = BINS,
    limit: int = MAP_LIMIT,
    sketches: Mapping[str, Sketch] | None = None,
) -> dict[str, list[float]]:
    """Inner edges of right-closed quantile bins; repeated edges are merged."""
    fractions = [i / bins for i in range(1, bins)]
    found = column_quantiles(df, columns, fractions, limit, sketches)
    return {c: sorted({e for e in edges if e is not None}) for c, edges in found.items()}


def quantile_bins(
    df: DataFrame, column: str, out: str, bins: int = BINS, limit: int = MAP_LIMIT
) -> DataFrame:
    """Add the number of a row's quantile bin, from 0; null values have none."""
    edges = bin_edges(df, [column], bins, limit)[column]
    return df.withColumn(out, bucket_of(F.col(column).cast("double"), edges))


def _is_binary(target: str) -> Column:
    value = F.col(target).cast("double")
    return F.count_if(~value.isin(0.0, 1.0)) == 0


def check_binary(df: DataFrame, target: str) -> DataFrame:
    """One row: ``is_binary``, true if every non-null value is 0 or 1."""
    return df.agg(_is_binary(target).alias("is_binary"))


def eligible_variables(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_TEXT_VALUES
) -> tuple[list[str], list[str]]:
    """Variables that can be ranked, and text variables with too many values."""
    text = [c for c in columns if not _is_number(df, c)]
    # Null is no category here; the limit counts it, so allow one more, then look.
    few: set[str] = set()
    if text:
        blanked = df.select(*text)
        rows = dimension_candidates(blanked, text, limit + 1).collect()
        exact = {r["variable"]: r["n_unique"] for r in rows}
        border = [c for c, n in exact.items() if n == limit + 1]
        few = {c for c, n in exact.items() if n <= limit}
        if border:
            nulls = blanked.agg(*(F.bool_or(F.col(c).isNull()).alias(c) for c in border)).first()
            few |= {c for c in border if nulls[c]}
    usable = [c for c in columns if c in few or _is_number(df, c)]
    return usable, [c for c in columns if c not in usable]


def _value_of(grouped: DataFrame) -> DataFrame:
    """IV and number of bins per variable, from good and bad counts per bin.

    Totals come from a second aggregate over the bins, a table of variables x
    bins rows.
    """
    totals = grouped.groupBy("variable").agg(
        F.sum("good").alias("all_good"),
        F.sum("bad").alias("all_bad"),
        F.count(F.lit(1)).alias("bins"),
    )
    floor = F.lit(FLOOR)

    def share(part: str) -> Column:
        p = F.col(part) / F.nullif(F.col(f"all_{part}"), F.lit(0))
        return F.when(p < floor, floor).otherwise(p)

    good, bad = share("good"), share("bad")
    term = (good - bad) * F.ln(good / bad)
    return (
        grouped.join(totals, "variable")
        .groupBy("variable", "bins")
        .agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("iv"))
    )


def iv_ranking(
    df: DataFrame,
    target: str,
    variables: Sequence[str],
    where: Predicate | None = None,
    bins: int = BINS,
    limit: int = MAP_LIMIT,
    max_text_values: int | None = MAX_TEXT_VALUES,
) -> DataFrame:
    """Information Value of every variable, strongest first.

    Columns are ``variable, iv, strength, n_values, reason``. A text variable
    with more than ``max_text_values`` values is not ranked: its row stands
    last, without a value but with the reason and its number of values (an
    estimate where the sketch is clear, exact near the limit). ``None`` ranks
    them all. ``n_values`` is null for numbers.

    All variables share three passes: checks and distinct-count sketches, the
    bin edges of all numeric variables, and the count of good and bad rows per
    variable and bin. Rows are repeated per variable only ahead of the partial
    aggregation in the same task.
    """
    kind = df.schema[target].dataType
    if not isinstance(kind, (NumericType, BooleanType)):
        raise TypeError(f"target {target!r} is neither numeric nor boolean")
    rows = keep(df, where)
    numeric = [c for c in variables if _is_number(df, c)]
    checks = rows.agg(
        _is_binary(target).alias("binary"),
        *sketch_aggregates(df, variables),
    ).first()
    if not checks["binary"]:
        raise ValueError(f"target {target!r} has values other than 0 and 1")
    sketches = read_sketches(df, variables, checks)
    most = float("inf") if max_text_values is None else max_text_values
    few = {c for c in variables if sketches[c].distinct <= 2 * most}
    usable = [c for c in variables if c in numeric or c in few]
    kinds = "variable string, is_number boolean, sketched bigint"
    listed = df.sparkSession.createDataFrame(
        [(c, c in numeric, None if c in usable else sketches[c].distinct) for c in variables], kinds
    )
    if not usable:
        nothing = df.sparkSession.createDataFrame([], "variable string, bins bigint, iv double")
        return _ranked(listed, nothing, max_text_values)
    known = rows.filter(F.col(target).isNotNull())
    edges = bin_edges(known, numeric, bins, limit, sketches)

    def bin_label(c: str) -> Column:
        if c in edges:
            return bucket_of(F.col(c).cast("double"), edges[c]).cast("string")
        return F.col(c).cast("string")

    entries = [F.struct(F.lit(c).alias("variable"), bin_label(c).alias("bin")) for c in usable]
    flag = F.col(target).cast("double")
    # Rows without a target count towards a text variable's values, nothing else.
    grouped = (
        rows.select(flag.alias("target"), F.inline(F.array(*entries)))
        .filter(F.col("bin").isNotNull())
        .groupBy("variable", "bin")
        .agg(
            F.count_if(F.col("target") == 0).alias("good"),
            F.count_if(F.col("target") == 1).alias("bad"),
        )
    )
    return _ranked(listed, _value_of(grouped), max_text_values)


def _ranked(listed: DataFrame, values: DataFrame, limit: int | None) -> DataFrame:
    """One row per listed variable, with its value or with the reason why it has none."""
    full = listed.join(values, "variable", "left")
    n_values = F.when(~F.col("is_number"), F.coalesce("sketched", "bins", F.lit(0)))
    skipped = F.lit(False) if limit is None else F.coalesce(n_values > limit, F.lit(False))
    # A variable without any usable row has no group, but a value of 0.
    iv = F.when(~skipped, F.coalesce("iv", F.lit(0.0)))
    return full.select(
        "variable",
        iv.alias("iv"),
        F.when(~skipped, strength_label(iv)).alias("strength"),
        n_values.cast("bigint").alias("n_values"),
        F.when(skipped, F.lit(f"more than {limit} values")).alias("reason"),
    ).orderBy(F.col("iv").desc(), "variable")


def information_value(
    df: DataFrame, variable: str, target: str, bins: int = BINS, limit: int = MAP_LIMIT
) -> DataFrame:
    """Information Value of one variable, one row."""
    return iv_ranking(df, target, [variable], bins=bins, limit=limit)
