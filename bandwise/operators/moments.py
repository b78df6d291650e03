"""Central moments that merge: variance, skewness, kurtosis, covariance and correlation of
large groups from those of small ones.

A state is a count, the means and sums of powers around the means. States are made from rows
by Spark's own aggregates and merged around the mean of the merged group, so that nothing
cancels however far the group lies from zero; a constant keeps a variance of exactly zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Moments:
    """Columns of one state, named from ``prefix``: one input up to a power, or two inputs."""

    def __init__(self, prefix: str, power: int = 2, pair: bool = False):
        self.prefix, self.pair = prefix, pair
        self.means = ["x", "y"] if pair else ["x"]
        self.sums = ["xx", "yy", "xy"] if pair else ["x" * p for p in range(2, power + 1)]

    def name(self, part: str) -> str:
        return f"{self.prefix}_{part}"

    def columns(self) -> dict[str, Column]:
        return {part: F.col(self.name(part)) for part in ["n", *self.means, *self.sums]}

    def of_rows(self, *inputs: Column) -> list[Column]:
        """Aggregates of rows; rows with a null input are left out."""
        if self.pair:
            both = inputs[0].isNotNull() & inputs[1].isNotNull()
            x, y = (F.when(both, c.cast("double")) for c in inputs)
        else:
            x = y = inputs[0].cast("double")
        n = F.count(x).cast("double")
        square = F.var_pop(x) * n
        made = {
            "n": n,
            "x": F.avg(x),
            "y": F.avg(y),
            "xx": square,
            "yy": F.var_pop(y) * n,
            "xy": F.covar_pop(x, y) * n,
            # Spark's skewness and excess kurtosis, solved for the sums; null where all values are equal.
            "xxx": F.coalesce(F.try_divide(F.skewness(x) * F.pow(square, 1.5), F.sqrt(n)), F.lit(0.0)),
            "xxxx": F.coalesce(F.try_divide((F.kurtosis(x) + 3) * square * square, n), F.lit(0.0)),
        }
        return [made[part].alias(self.name(part)) for part in ["n", *self.means, *self.sums]]

    def _offset(self, mean: str) -> str:
        return f"{self.prefix}_d{mean}"

    def offsets(self, over: Window) -> dict[str, Column]:
        """How far the mean of each state lies from that of its merged group."""
        n = F.col(self.name("n"))
        found = {}
        for mean in self.means:
            value = F.col(self.name(mean))
            # From the smallest mean, so that equal means differ by exactly zero.
            above = value - F.min(value).over(over)
            whole = F.try_divide(F.sum(n * above).over(over), F.sum(n).over(over))
            found[self._offset(mean)] = above - whole
        return found

    def merged(self) -> list[Column]:
        """Aggregates of states that have their offsets."""
        p = self.columns()
        n, d = p["n"], {mean: F.col(self._offset(mean)) for mean in self.means}
        dx, dy = d["x"], d.get("y")
        made = {"n": F.sum(n)}
        for mean in self.means:
            # All states of a group have the same mean of the group.
            made[mean] = F.max(p[mean] - d[mean])
        if self.pair:
            made["xx"] = F.sum(p["xx"] + n * dx * dx)
            made["yy"] = F.sum(p["yy"] + n * dy * dy)
            made["xy"] = F.sum(p["xy"] + n * dx * dy)
        else:
            terms = {"xx": p["xx"] + n * dx * dx}
            if "xxx" in p:
                terms["xxx"] = p["xxx"] + 3 * dx * p["xx"] + n * dx * dx * dx
            if "xxxx" in p:
                square = dx * dx
                terms["xxxx"] = p["xxxx"] + 4 * dx * p["xxx"] + 6 * square * p["xx"] + n * square * square
            made.update({part: F.sum(term) for part, term in terms.items()})
        return [made[part].alias(self.name(part)) for part in ["n", *self.means, *self.sums]]


def merge(
    states: DataFrame,
    keys: Sequence[str],
    moments: Sequence[Moments],
    others: Sequence[Column] = (),
    salt: str | None = None,
) -> DataFrame:
    """States of one key become one; ``others`` are aggregates that may be applied repeatedly.

    With a column ``salt``, the states of a key are first merged per value of it, so that no
    task holds all of them.
    """
    keys = list(keys)
    if salt is not None:
        states = merge(states, [*keys, salt], moments, others).drop(salt)
    over = Window.partitionBy(*keys)
    offsets = {name: column for m in moments for name, column in m.offsets(over).items()}
    merged = [column for m in moments for column in m.merged()]
    centred = states.withColumns(offsets) if offsets else states
    return centred.groupBy(*keys).agg(*others, *merged)


def variance_of(p: dict[str, Column], total: str = "xx") -> Column:
    """Sample variance, or covariance; null below two values."""
    return F.when(p["n"] > 1, F.try_divide(p[total], p["n"] - 1))


def skewness_of(p: dict[str, Column]) -> Column:
    """Null where all values are equal."""
    return F.when(p["xx"] != 0, F.try_divide(F.sqrt(p["n"]) * p["xxx"], F.pow(p["xx"], 1.5)))


def kurtosis_of(p: dict[str, Column]) -> Column:
    """Excess kurtosis; null where all values are equal."""
    return F.when(p["xx"] != 0, F.try_divide(p["n"] * p["xxxx"], p["xx"] * p["xx"]) - 3)


def correlation_of(p: dict[str, Column]) -> Column:
    """Null below two pairs and where one side is constant."""
    return F.when(p["n"] > 1, F.try_divide(p["xy"], F.sqrt(p["xx"]) * F.sqrt(p["yy"])))
