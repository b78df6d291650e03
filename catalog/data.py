"""The loan view over the supplied tables, in Spark and in SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwise.sources.union import union_sources

CUTOFF = "1999-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_loans(lineitem: DataFrame) -> DataFrame:
    """Returned items are bad; the discount on them is the loss; the price is the balance."""
    returned = F.col("l_returnflag") == "R"
    return lineitem.withColumns(
        {
            "bad": returned.cast("int"),
            "loss": F.when(returned, F.col("l_extendedprice") * F.col("l_discount")).otherwise(0.0),
            "balance": F.col("l_extendedprice"),
            "discount_pct": F.round(F.col("l_discount") * 100).cast("int"),
            "tax_pct": F.round(F.col("l_tax") * 100).cast("int"),
        }
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_loans(table(spark, sf_dir, "lineitem"))


def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Development and test loans as two stacked sources."""
    rows = loans(spark, sf_dir)
    cutoff = F.lit(CUTOFF).cast("timestamp")
    return union_sources(
        {"dev": rows.filter(F.col("l_shipdate") < cutoff), "test": rows.filter(F.col("l_shipdate") >= cutoff)}
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with the attributes of their order; both sides are large, no hint."""
    orders = table(spark, sf_dir, "orders")
    rows = loans(spark, sf_dir)
    return rows.join(orders, rows.l_orderkey == orders.o_orderkey)


def shared_folder(spark: SparkSession) -> str:
    """A new folder every executor can reach: under ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine, as in tests, a local one is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/bandwise-{uuid.uuid4().hex}"
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.mkdtemp(prefix='bandwise-')}/data"


def rounded(column: Column | str, digits: int = 4) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c.cast("double"), digits)


def round_columns(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n, digits) for n in names})


# The same view in SQL.
LOANS = """loans AS (
  SELECT *,
    CAST(l_returnflag = 'R' AS INT) AS bad,
    CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount ELSE 0.0 END AS loss,
    l_extendedprice AS balance,
    CAST(round(l_discount * 100) AS INT) AS discount_pct,
    CAST(round(l_tax * 100) AS INT) AS tax_pct,
    CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'dev' ELSE 'test' END AS source
  FROM lineitem)"""

ACCOUNTS = LOANS + """, accounts AS (
  SELECT * FROM loans JOIN orders ON l_orderkey = o_orderkey)"""
