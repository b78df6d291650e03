"""Records of delimited text whose quoted cells may hold line breaks, from splits read in parallel.

Whether a line starts inside a quoted cell depends on all lines before it. But
a line only maps one of two states (outside, inside) to another, and so does a
block of lines: one pass finds the map of each block, their composition gives
the state each block starts in, and a second pass cuts every block into records
on its own. Only the pieces of records that cross a border are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUOTE = '"'


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``file``, ``start`` of their block, and ``position`` in the first block of their file.

    Numbers rise within a block, so a line's position never depends on its
    content. The first block of a file always holds its opening lines.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    )
    firsts = lines.filter("start = 0").groupBy("file").agg(F.min("line").alias("first"))
    # One row per file, so no larger than the file listing the driver holds anyway;
    # a shuffle by file would put each file into one task.
    position = F.when(F.col("start") == 0, F.col("line") - F.col("first"))
    return lines.join(F.broadcast(firsts), "file").withColumn("position", position).drop("first")


def ends_inside(line: Column, delimiter: str) -> tuple[Column, Column]:
    """Whether a quoted cell is open after a line, if none was open before it and if one was.

    A quote opens a cell only at its start; elsewhere in an unquoted cell it is
    a character. A doubled quote changes nothing in either state. What follows
    a closing quote belongs to the cell up to the next delimiter.
    """
    d = f"\\x{{{ord(delimiter):x}}}"
    plain = F.regexp_replace(line, '""', "")
    any_quote = F.contains(line, F.lit(QUOTE))

    def opened(text: Column) -> Column:
        closed = F.regexp_replace(text, f'(^|{d})"[^"]*"[^{d}]*', "$1")
        return closed.rlike(f'(^|{d})"')

    behind = F.regexp_replace(plain, f'^[^"]*"[^{d}]*', "")
    inside = ~F.contains(plain, F.lit(QUOTE)) | opened(behind)
    return any_quote & opened(plain), ~any_quote | inside


def _segments(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """Runs of rows of one block: file, start, first and last row."""
    files, starts = batch.column("file"), batch.column("start").to_numpy()
    codes = files.dictionary_encode().indices.to_numpy()
    borders = np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1
    ends = [0, *borders.tolist(), batch.num_rows]
    for low, high in zip(ends, ends[1:]):
        if high > low:
            yield files[low].as_py(), int(starts[low]), low, high


def _states(state: bool, if_out: list[bool], if_in: list[bool]) -> list[bool]:
    """The state after each line."""
    found = []
    for outside, inside in zip(if_out, if_in):
        state = inside if state else outside
        found.append(state)
    return found


def _block_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each block, from the maps of its lines, and whether a record that is open at its start ends in it."""
    held: dict[tuple[str, int], tuple[bool, bool, bool]] = {}
    for batch in batches:
        for file, start, low, high in _segments(batch):
            if_out, if_in, ends = held.get((file, start), (False, True, False))
            maps = [batch.column(c).slice(low, high - low).to_pylist() for c in ("if_out", "if_in")]
            from_in = _states(if_in, *maps)
            held[file, start] = (_states(if_out, *maps)[-1], from_in[-1], ends or not all(from_in))
    if held:
        files, starts = zip(*held)
        columns = [pa.array(files), pa.array(starts, pa.int64()), *(pa.array(c) for c in zip(*held.values()))]
        yield pa.RecordBatch.from_arrays(columns, names=["file", "start", "if_out", "if_in", "ends"])


def _cut(opening):
    """Map function: whole records, and the pieces of those that cross a border of blocks.

    ``opening`` tells, for each block that starts inside a record, the block in
    which that record begins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, pending, out = None, None, []

        def row(kind: int, value: str, position, origin: int) -> None:
            out.append((kind, value, block[0], block[1], position, origin))

        def leave() -> None:
            """The block ends; what is still open goes on in the next one."""
            if pending is not None:
                text, position, origin = pending
                row(1, "\n".join(text), position, origin)

        for batch in batches:
            for file, start, low, high in _segments(batch):
                if block != (file, start):
                    if block:
                        leave()
                    block, pending = (file, start), None
                    origin = opening.value.get(block)
                    if origin is not None:
                        pending = ([], None, origin)
                part = batch.slice(low, high - low)
                columns = (part.column(c).to_pylist() for c in ("value", "position", "if_out", "if_in"))
                for value, position, if_out, if_in in zip(*columns):
                    if pending is None:
                        if if_out:
                            pending = ([value], position, start)
                        else:
                            row(0, value, position, start)
                    else:
                        pending[0].append(value)
                        if not if_in:
                            text, position, origin = pending
                            row(0 if origin == start else 1, "\n".join(text), position, origin)
                            pending = None
                    if len(out) >= 10_000:
                        yield _rows(out)
                        out.clear()
        if block:
            leave()
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["kind", "value", "file", "start", "position", "origin"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def _openings(maps: list) -> dict[tuple[str, int], int]:
    """Blocks that start inside a record, and where the record begins; rows are (file, start, if_out, if_in, ends)."""
    found = {}
    for file, blocks in groupby(sorted(maps), key=lambda m: m[0]):
        state, origin = False, 0
        for _, start, if_out, if_in, ends in blocks:
            if state:
                found[file, start] = origin
            if ends or not state:  # what is open at its end, began in it
                origin = start
            state = if_in if state else if_out
    return found


def with_maps(lines: DataFrame, delimiter: str, header_row: int = 0) -> DataFrame:
    """Lines with ``if_out`` and ``if_in``; lines before the header mean nothing."""
    if_out, if_in = ends_inside(F.col("value"), delimiter)
    if header_row:
        ahead = F.coalesce(F.col("position") < header_row, F.lit(False))
        if_out, if_in = ~ahead & if_out, ahead | if_in
    return lines.withColumns({"if_out": if_out, "if_in": if_in})


def has_open_quotes(lines: DataFrame) -> bool:
    """Whether a quoted cell is open at the end of any line."""
    return not lines.filter("if_out").select(F.lit(1)).isEmpty()


def records_of(lines: DataFrame) -> DataFrame:
    """Records (``value``) with ``file`` and ``position`` of their first line, from lines with their maps.

    The driver learns three booleans for each block, of which there are no more
    than splits it deals out. A record that is never closed ends with its file.
    """
    spark = lines.sparkSession
    blocks = lines.select("file", "start", "if_out", "if_in")
    maps = blocks.mapInArrow(
        _block_maps, "file string, start long, if_out boolean, if_in boolean, ends boolean"
    )
    opening = spark.sparkContext.broadcast(_openings([tuple(r) for r in maps.collect()]))
    slim = lines.select("value", "file", "start", "position", "if_out", "if_in")
    pieces = slim.mapInArrow(
        _cut(opening), "kind int, value string, file string, start long, position long, origin long"
    )
    whole = pieces.filter("kind = 0").select("value", "file", "position")
    in_order = F.array_sort(F.collect_list(F.struct("start", "value")))
    joined = pieces.filter("kind = 1").groupBy("file", "origin").agg(
        F.array_join(in_order.getField("value"), "\n").alias("value"), F.min("position").alias("position")
    )
    return whole.unionByName(joined.select("value", "file", "position"))
