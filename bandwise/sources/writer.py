"""Writing a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_scored(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    rebalance: bool = True,
    replace_partitions: bool = False,
) -> None:
    """Write one table; ``partition_by`` lays it out by segment for later pruning.

    With ``rebalance``, rows are first brought together by segment, so that a
    segment has few files however many tasks scored it; adaptive execution
    splits a segment that holds most of the rows over many tasks, to files of
    about its advisory partition size, and joins small ones. Without it, every
    task writes the segments it holds and nothing is shuffled.

    With ``replace_partitions``, only the segments found in ``df`` are replaced;
    the others stay as they are. Rerunning the write of some segments is safe.
    """
    if replace_partitions and not partition_by:
        raise ValueError("replacing partitions needs partition columns")
    if partition_by and rebalance:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format(format).mode("overwrite" if replace_partitions else mode)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
