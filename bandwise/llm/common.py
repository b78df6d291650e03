"""What several operators share: tables, cut lineage, text conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ASCII white space and letters, as the contracts of the operators name them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_root(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the cluster names none, as in tests."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="bandwise-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable storage: computed once, and still there when executors are lost."""
    _shared_root(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path nobody uses yet, in the shared folder."""
    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Like `cut`, as Parquet: smaller for wide rows, and later reads can prune columns."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(column, UPPER, LOWER)


def strip(column: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(column, F.lit(SPACES))


def text_key(*columns: Column) -> tuple[Column, Column]:
    """128 bits of the columns as two longs; the second hash starts from another seed."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def remainder_of_id(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(column.cast("string").cast("binary")) % divisor


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `_at`, the place of a row within its group in the given order from 0, and `_n`, the rows of the group.

    Ranges of (group, order) are sorted in parallel and written once, so that each row keeps its place when an executor
    is lost; what a group has in earlier ranges comes from a table of one row a group and range. Groups may hold any
    share of the rows, but rows that are equal in all of `order` stay in one range.
    """
    run = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    run = stored(run.withColumn("_place", F.monotonically_increasing_id()), "sorted")
    run = run.withColumn("_range", F.shiftright("_place", 33))
    w = Window.partitionBy(group).orderBy("_range")
    before = F.coalesce(F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = run.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    starts = sizes.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(Window.partitionBy(group)).alias("_n"))
    return run.join(starts, [group, "_range"]).withColumn("_at", F.col("_place") + F.col("_shift")).drop("_place", "_range", "_shift")
