"""Arithmetic and math functions with IEEE results instead of errors or nulls.

Spark raises on division by zero under ANSI and answers null outside a
function's domain. A loss rate over an empty balance has to stay visible, so
these helpers return +/-inf and NaN the way floating-point hardware does.
Null stays null everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def as_column(value: Column | str) -> Column:
    """A column name or an expression, as an expression."""
    return value if isinstance(value, Column) else F.col(value)


def ratio(numerator: Column, denominator: Column) -> Column:
    """True division: x/0 is +/-inf, 0/0 is NaN, null if either side is null."""
    n = numerator.cast("double")
    d = denominator.cast("double")
    by_zero = (
        F.when(F.isnan(n) | (n == 0), F.lit(NAN))
        .when(n > 0, F.lit(INF))
        .when(n < 0, F.lit(-INF))
    )
    return F.when(d == 0, by_zero).otherwise(F.try_divide(n, d))


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    return F.when(b > 0, F.pmod(a, b)).when(b < 0, -F.pmod(-a, -b))


def floor_divide(a: Column, b: Column) -> Column:
    """Integer quotient rounded towards minus infinity; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a - modulo(a, b), b))


def floor_divide_real(a: Column, b: Column) -> Column:
    """Floor of a true division, as a double; zero divisors give inf or NaN."""
    q = ratio(a, b)
    finite = q.isNotNull() & ~F.isnan(q) & (F.abs(q) != INF)
    whole = (a.cast("double") - modulo(a.cast("double"), b.cast("double"))) / b
    return F.when(finite, F.rint(whole)).otherwise(q)


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def _log(x: Column, function, edge: float) -> Column:
    value = x.cast("double")
    return (
        F.when(value < edge, F.lit(NAN))
        .when(value == edge, F.lit(-INF))
        .otherwise(function(value))
    )


def ln(x: Column) -> Column:
    """Natural logarithm: -inf at zero, NaN below."""
    return _log(x, F.ln, 0.0)


def log10(x: Column) -> Column:
    """Decimal logarithm: -inf at zero, NaN below."""
    return _log(x, F.log10, 0.0)


def log1p(x: Column) -> Column:
    """ln(1 + x): -inf at minus one, NaN below."""
    return _log(x, F.log1p, -1.0)
