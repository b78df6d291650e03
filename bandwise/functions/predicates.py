"""Boolean row predicates.

Anything Spark already spells (``==``, ``isin``, ``isNull``, ``rlike``...) is
used directly by callers; only the pieces with a rule of their own are here.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

Predicate = Column | str

COMPARISONS = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}


def predicate(value: Predicate) -> Column:
    """A boolean Column, or a Spark SQL boolean expression as text."""
    return F.expr(value) if isinstance(value, str) else value


def first_match(cases: Iterable[tuple[Column, Column]], otherwise: Column) -> Column:
    """Value of the first condition that is true, as one flat CASE."""
    chain = None
    for condition, value in cases:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return otherwise if chain is None else chain.otherwise(otherwise)


def all_of(predicates: Iterable[Predicate]) -> Column:
    """AND of every predicate; none at all keeps every row."""
    return reduce(operator.and_, (predicate(p) for p in predicates), F.lit(True))


def keep(df: DataFrame, *predicates: Predicate | None) -> DataFrame:
    """Rows for which every predicate is true; null drops the row."""
    given = [p for p in predicates if p is not None]
    return df.filter(all_of(given)) if given else df


def between_chain(*terms: Column | str) -> Column:
    """Chained comparison: ``between_chain(a, "<", x, "<=", b)``."""
    if len(terms) < 3 or len(terms) % 2 == 0:
        raise ValueError("expected operand, operator, operand, ...")
    links = [
        COMPARISONS[terms[i]](terms[i - 1], terms[i + 1]) for i in range(1, len(terms), 2)
    ]
    return all_of(links)


def either(a: Column, b: Column) -> Column:
    """Exclusive or; null if either side is null."""
    return a != b


def compare(df: DataFrame, column: str, comparison: str, value: object) -> Column:
    """Column against a literal, refusing to mix text with numbers.

    Spark would cast the text and fail on the first row that is not a number;
    the schema is enough to say so before anything runs.
    """
    if comparison not in COMPARISONS:
        raise ValueError(f"unknown comparison {comparison!r}")
    kind = df.schema[column].dataType
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    clash = (
        (isinstance(kind, NumericType) and isinstance(value, str))
        or (isinstance(kind, StringType) and is_number)
        or (isinstance(kind, BooleanType) and isinstance(value, str))
    )
    if clash:
        raise TypeError(f"column {column!r} is {kind.simpleString()}, compared with {value!r}")
    return COMPARISONS[comparison](F.col(column), F.lit(value))


def above_population(df: DataFrame, column: str, aggregate: Column) -> DataFrame:
    """Rows whose value exceeds an aggregate over the whole frame."""
    return df.filter(F.col(column) > df.agg(aggregate).scalar())
