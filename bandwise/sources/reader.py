"""Delimited text files with types inferred over the whole file.

Column types are limited to bigint, double, boolean and string: Spark's own
inference also produces int, date and timestamp, which would make the type of
a column depend on which file it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from bandwise.sources.records import has_open_quotes, lines_of, records_of, with_maps

WHITESPACE = r"\s+"

# What a text cell must look like to count as a given type.
INTEGER_TEXT = r"^[-+]?\d+$"
FLOAT_TEXT = r"^[-+]?((\d*\.\d+|\d+\.?)([eE][-+]?\d+)?|inf|NaN)$"
BOOLEAN_TEXT = r"^(?i:true|false)$"


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    header_row: int = 0,
    schema: StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read delimited text; the first ``header_row`` lines of each file are skipped.

    ``schema`` skips inference, which otherwise costs one pass over the data.
    Quoted cells may hold delimiters, doubled quotes and line breaks; a quote
    that does not open a cell is a character, and every line break in a cell is
    read as a line feed. Files are read in splits whether
    cells hold line breaks or not. ``multi_line`` says whether they do; None
    finds out in a pass of its own. With False, and for delimiters of several
    characters, a cell that is still open at the end of its line ends there. Cells that a row has too many are dropped, those
    it lacks are null, as is a cell that doesn't fit the given schema. Lines
    without any character but blanks are skipped. Whitespace-separated text has
    no quotes.
    """
    if header_row < 0:
        raise ValueError("header_row must not be negative")
    if delimiter == WHITESPACE:
        cells = _cells_from_lines(_numbered_lines(spark, path), path, delimiter, header_row)
    else:
        broken = None
        if multi_line and len(delimiter) != 1:
            raise ValueError("line breaks in cells need a delimiter of one character")
        if multi_line is not False and len(delimiter) == 1:
            lines = with_maps(_numbered_lines(spark, path), delimiter, header_row)
            if multi_line or has_open_quotes(lines):
                broken = records_of(lines)
        if broken is not None:
            cells = _cells_from_lines(broken, path, delimiter, header_row)
        elif header_row == 0:
            cells = spark.read.options(header=True, **_options(delimiter))
            if schema is not None:
                texts = [StructField(f.name, StringType()) for f in schema.fields]
                cells = cells.schema(StructType(texts))
            cells = cells.csv(path)
        else:
            cells = _cells_from_lines(_numbered_lines(spark, path), path, delimiter, header_row)
    if schema is None:
        schema = infer_schema(cells)
    return cells.select(*(_typed(F.col(f"`{f.name}`"), f) for f in schema.fields))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark, path).withColumn("value", F.regexp_replace("value", "\r$", ""))


def infer_schema(text: DataFrame) -> StructType:
    """Narrowest type that fits every cell of each text column, in one pass."""

    def fits(name: str, pattern: str, target: str | None = None) -> Column:
        c = F.col(f"`{name}`")
        ok = c.rlike(pattern)
        if target:
            ok = ok & c.try_cast(target).isNotNull()
        # A missing cell fits every type, but a column of them is text.
        return F.bool_and(c.isNull() | ok) & (F.count(c) > 0)

    checks = []
    for i, name in enumerate(text.columns):
        checks += [
            fits(name, INTEGER_TEXT, "bigint").alias(f"i{i}"),
            fits(name, f"{INTEGER_TEXT}|{FLOAT_TEXT}").alias(f"f{i}"),
            fits(name, BOOLEAN_TEXT).alias(f"b{i}"),
        ]
    if not checks:
        return StructType([])
    row = text.agg(*checks).first()

    def pick(i: int) -> str:
        if row[f"i{i}"]:
            return "bigint"
        if row[f"f{i}"]:
            return "double"
        return "boolean" if row[f"b{i}"] else "string"

    ddl = ", ".join(f"`{name}` {pick(i)}" for i, name in enumerate(text.columns))
    return StructType.fromDDL(ddl)


def _options(delimiter: str) -> dict[str, str]:
    """How cells are quoted: a quote within quotes is doubled, a backslash is a character like others."""
    return {"sep": delimiter, "quote": '"', "escape": '"'}


def _typed(cell: Column, field: StructField) -> Column:
    return cell.try_cast(field.dataType).alias(field.name)


def _cells_from_lines(
    lines: DataFrame, path: str, delimiter: str, header_row: int
) -> DataFrame:
    """Text columns of lines or records, with the header at a position in the first block of each file."""
    spark = lines.sparkSession
    header = (
        lines.filter(F.col("position") == header_row)
        .select(F.min_by("value", "file").alias("value"))
        .first()["value"]
    )
    if header is None:
        raise ValueError(f"no header line {header_row} in {path}")
    body = lines.filter(
        (F.col("position").isNull() | (F.col("position") > header_row))
        & (F.trim("value") != "")
    ).select("value")

    if delimiter == WHITESPACE:
        names = header.split()
        parts = F.split(F.trim("value"), WHITESPACE)
        return body.select(
            *(F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names))
        )
    head_schema = StructType([StructField("line", StringType())])
    names_row = spark.createDataFrame([(header,)], head_schema)
    width = header.count(delimiter) + 1  # at least; quoted names may hold delimiters
    raw = ", ".join(f"c{i} string" for i in range(width))
    options = _options(delimiter)
    first = names_row.select(F.from_csv("line", raw, options).alias("r")).first()["r"]
    names = [n for n in first if n is not None]
    wanted = ", ".join(f"`{n}` string" for n in names)
    return body.select(F.from_csv("value", wanted, options).alias("r")).select("r.*")
