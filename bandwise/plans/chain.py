"""A segmentation chain: one root variable, then refinements, applied to any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.operators.bands import Band, assign, assign_lookup
from bandwise.operators.grid import assign_grid, target_of

SEGMENT = "segment"


@dataclass(frozen=True)
class Step:
    """One variable of a chain.

    The root step has no grid: its band ids are the segment ids. Every later
    step maps (band, parent segment) to a target segment.

    With ``categories_path`` the categories are not listed in ``bands``, which
    then only give the ids, but in a Parquet table ``band_id, category`` there.
    Scoring joins it, so a band may hold any number of categories. A category in
    several bands belongs to the lowest that is enabled and in the grid.
    """

    variable: str
    bands: tuple[Band, ...]
    grid: Mapping[tuple[int, int], int] | None = None
    disabled: frozenset[int] = field(default_factory=frozenset)
    categories_path: str | None = None

    def active(self) -> list[int]:
        """Ids of the bands that can assign a row: enabled, and in the grid if there is one."""
        targets = None if self.grid is None else {b for b, _ in self.grid}
        return [b.id for b in self.bands if b.id not in self.disabled and (targets is None or b.id in targets)]

    def band(self) -> Column:
        """Band of the row's value, grid or not."""
        if self.categories_path is not None:
            raise ValueError(f"the categories of {self.variable!r} are a table; use with_band")
        return assign(F.col(self.variable), [b for b in self.bands if b.id not in self.disabled])

    def segment(self, parent: Column | None) -> Column:
        if self.grid is None:
            return self.band()
        if parent is None:
            raise ValueError("the first step of a chain cannot have a grid")
        return assign_grid(F.col(self.variable), parent, self.bands, self.grid, self.disabled)

    def with_band(self, df: DataFrame, out: str) -> DataFrame:
        """Adds the band of the row's value, grid or not."""
        if self.categories_path is None:
            return df.withColumn(out, self.band())
        return self._joined(df, [b.id for b in self.bands if b.id not in self.disabled], out)

    def with_segment(self, df: DataFrame, parent: str | None, out: str) -> DataFrame:
        """Adds the segment of the row's value and its parent segment."""
        if self.categories_path is None:
            return df.withColumn(out, self.segment(None if parent is None else F.col(parent)))
        if self.grid is None:
            return self._joined(df, self.active(), out)
        if parent is None:
            raise ValueError("the first step of a chain cannot have a grid")
        joined = self._joined(df, self.active(), "__member__")
        return joined.withColumn(out, target_of(F.col("__member__"), F.col(parent), self.grid)).drop("__member__")

    def _joined(self, df: DataFrame, ids: Sequence[int], out: str) -> DataFrame:
        table = df.sparkSession.read.parquet(self.categories_path)
        return assign_lookup(df, self.variable, table.filter(F.col("band_id").isin(list(ids))), out)


Chain = Sequence[Step]


def check_chain(df: DataFrame, chain: Chain) -> None:
    if not chain:
        raise ValueError("empty chain")
    for i, step in enumerate(chain):
        if step.variable not in df.columns:
            raise ValueError(f"column {step.variable!r} does not exist")
        if (step.grid is None) != (i == 0):
            raise ValueError("exactly the first step of a chain is without a grid")


def score(df: DataFrame, chain: Chain, out: str = SEGMENT) -> DataFrame:
    """Add one column per step, ``<out>_1`` ..., and the final segment as ``out``.

    A projection only: no join, no shuffle. Only steps whose categories are a
    table add a left join with it. Both work on a stream as well.
    """
    check_chain(df, chain)
    result, parent = df, None
    for i, step in enumerate(chain, start=1):
        name = f"{out}_{i}"
        result = step.with_segment(result, parent, name)
        parent = name
    return result.withColumn(out, F.col(parent))


# --- the chain as SQL text ------------------------------------------------


def _number(value: float) -> str:
    if value == float("inf"):
        return "CAST('Infinity' AS DOUBLE)"
    if value == float("-inf"):
        return "CAST('-Infinity' AS DOUBLE)"
    return f"CAST({value!r} AS DOUBLE)"


def _name(column: str, quote: str) -> str:
    return quote + column.replace(quote, quote * 2) + quote


def _text(value: str, dialect: str) -> str:
    """A string literal: with backslashes for Spark, with doubled quotes for standard SQL."""
    if dialect == "spark":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "'" + value.replace("'", "''") + "'"


def _condition(column: str, band: Band, dialect: str) -> str:
    if band.categories is not None:
        if not band.categories:
            return "FALSE"
        members = ", ".join(_text(c, dialect) for c in sorted(band.categories))
        kind = "STRING" if dialect == "spark" else "VARCHAR"
        return f"CAST({column} AS {kind}) IN ({members})"
    return f"{column} > {_number(band.lower)} AND {column} <= {_number(band.upper)}"


def step_sql(
    step: Step, parent: str | None, quote: str = "`", dialect: str | None = None
) -> str:
    """One CASE expression for a step; the dialect follows the quote of names unless given.

    A row belongs to the first band that holds it, also where the grid has no
    target for the band and its parent.
    """
    dialect = dialect or ("spark" if quote == "`" else "standard")
    column = _name(step.variable, quote)
    lines = []
    for b in step.bands:
        if b.id in step.disabled:
            continue
        when = _condition(column, b, dialect)
        if step.grid is None:
            lines.append(f"  WHEN {when} THEN {b.id}")
            continue
        cells = [
            f"WHEN {parent_id} THEN {target}"
            for (band_id, parent_id), target in step.grid.items()
            if band_id == b.id
        ]
        target = f"CASE {parent} {' '.join(cells)} END" if cells else "CAST(NULL AS INT)"
        lines.append(f"  WHEN {when} THEN {target}")
    if not lines:
        return "CAST(NULL AS INT)"
    return "\n".join(["CASE", *lines, "END"])


def _table_step_sql(
    step: Step, parent: str | None, at: int, quote: str, dialect: str, source: str
) -> tuple[str, str]:
    """The expression of a step whose categories are a table, and the join it needs."""
    ids = ", ".join(str(i) for i in step.active()) or "NULL"
    kind = "STRING" if dialect == "spark" else "VARCHAR"
    members = (
        f"SELECT category, MIN(band_id) AS band_id FROM {source}\n"
        f"  WHERE category IS NOT NULL AND band_id IN ({ids}) GROUP BY category"
    )
    value = f"CAST(s{at}.{_name(step.variable, quote)} AS {kind})"
    join = f"LEFT JOIN ({members}) AS c{at} ON {value} = c{at}.category"
    if step.grid is None:
        return f"c{at}.band_id", join
    lines = [
        f"  WHEN c{at}.band_id = {b} AND s{at}.{parent} = {p} THEN {target}"
        for (b, p), target in step.grid.items()
        if b in step.active()
    ]
    return "\n".join(["CASE", *lines, "END"]) if lines else "CAST(NULL AS INT)", join


def scoring_sql(
    chain: Chain,
    table: str,
    out: str = SEGMENT,
    quote: str = "`",
    dialect: str | None = None,
    category_tables: Mapping[str, str] | None = None,
) -> str:
    """A query that scores ``table``, one nested SELECT per step.

    ``category_tables`` names, by the path a step holds, the table to join for its categories;
    Spark reads the path itself where none is named, other systems need a name.
    """
    dialect = dialect or ("spark" if quote == "`" else "standard")
    names = category_tables or {}
    query, parent = f"SELECT * FROM {table}", None
    for i, step in enumerate(chain, start=1):
        name, path = _name(f"{out}_{i}", quote), step.categories_path
        if path is None:
            query = f"SELECT *, {step_sql(step, parent, quote, dialect)} AS {name}\nFROM ({query}) AS s{i}"
        else:
            if path not in names and dialect != "spark":
                raise ValueError(f"no table named for the categories of {step.variable!r}")
            source = names.get(path) or f"parquet.{_name(path, '`')}"
            value, join = _table_step_sql(step, parent, i, quote, dialect, source)
            query = f"SELECT s{i}.*, {value} AS {name}\nFROM ({query}) AS s{i}\n{join}"
        parent = name
    return f"SELECT *, {parent} AS {_name(out, quote)}\nFROM ({query}) AS scored"
