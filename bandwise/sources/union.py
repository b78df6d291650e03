"""Several named tables stacked into one, with every row keeping its origin."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    NumericType,
    ShortType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

SOURCE = "__source__"
NUMERICAL = "Numerical"
CATEGORICAL = "Categorical"

_INTEGERS = (ByteType, ShortType, IntegerType, LongType)
_TIMES = (DateType, TimestampType, TimestampNTZType)


def supertype(a: DataType, b: DataType) -> DataType:
    """Type that holds both: integers widen, numbers go to double, the rest to text."""
    if a == b:
        return a
    if isinstance(a, _INTEGERS) and isinstance(b, _INTEGERS):
        return LongType()
    numeric = (NumericType, BooleanType)
    if isinstance(a, numeric) and isinstance(b, numeric):
        whole = (*_INTEGERS, BooleanType)
        if isinstance(a, whole) and isinstance(b, whole):
            return LongType()
        return DoubleType()
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return TimestampType()
    return StringType()


def supertype_schema(schemas: Iterable[StructType]) -> StructType:
    """Columns of every schema in order of appearance, widened where they differ."""
    merged: dict[str, DataType] = {}
    for schema in schemas:
        for field in schema.fields:
            seen = merged.get(field.name)
            merged[field.name] = (
                field.dataType if seen is None else supertype(seen, field.dataType)
            )
    return StructType([StructField(name, kind, True) for name, kind in merged.items()])


def _cast_number_to_text(kind: DataType, target: DataType) -> bool:
    return isinstance(target, StringType) and isinstance(kind, (FloatType, DecimalType))


def _chosen(
    sources: Mapping[str, DataFrame], ids: Sequence[str] | None
) -> dict[str, DataFrame]:
    wanted = sources.keys() if ids is None else ids
    return {name: sources[name] for name in wanted if name in sources}


def union_sources(
    sources: Mapping[str, DataFrame],
    ids: Sequence[str] | None = None,
    limit_per_source: int | None = None,
) -> DataFrame:
    """Stack the chosen tables by column name; absent columns are null.

    Unknown ids are skipped. ``__source__`` carries the label of the table a
    row came from, so later steps can restrict themselves to some sources
    without a second scan.
    """
    chosen = _chosen(sources, ids)
    if not chosen:
        if not sources:
            raise ValueError("no sources")
        # No table chosen: same columns, no rows.
        return union_sources(sources).limit(0)
    target = supertype_schema(df.schema for df in chosen.values())
    stacked = []
    for label, df in chosen.items():
        if limit_per_source is not None:
            df = df.limit(limit_per_source)
        columns = []
        for field in target.fields:
            if field.name not in df.columns:
                continue
            c = F.col(f"`{field.name}`")
            if _cast_number_to_text(df.schema[field.name].dataType, field.dataType):
                c = c.cast("double")
            columns.append(c.cast(field.dataType).alias(field.name))
        stacked.append(df.select(*columns, F.lit(label).alias(SOURCE)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked).select(
        *(F.col(f"`{f.name}`") for f in target.fields), SOURCE
    )


def common_columns(
    sources: Mapping[str, DataFrame], ids: Sequence[str] | None = None
) -> list[tuple[str, str]]:
    """Columns present in every chosen table, marked numerical or categorical.

    The kind comes from the type over *all* tables, since that is the type the
    column has once they are stacked.
    """
    chosen = _chosen(sources, ids)
    if not chosen:
        return []
    shared = set.intersection(*(set(df.columns) for df in chosen.values()))
    full = supertype_schema(df.schema for df in sources.values())
    return sorted((f.name, kind_of(f.dataType)) for f in full.fields if f.name in shared)


def kind_of(data_type: DataType) -> str:
    return NUMERICAL if isinstance(data_type, NumericType) else CATEGORICAL


def only_sources(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Rows of the given sources; an empty list keeps none."""
    return df.filter(F.col(SOURCE).isin(list(ids)) if ids else F.lit(False))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    """The first rows of a table, for display."""
    return df.limit(rows)
