"""Small tables brought to the driver, with a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

#: Bands, segments and grid cells are configuration; a larger table is none.
MAX_ROWS = 100_000


def bounded_rows(frame: DataFrame, limit: int = MAX_ROWS) -> list[Row]:
    """All rows of a table of at most ``limit`` rows; longer ones are refused, never cut."""
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows of configuration")
    return rows
