"""Filters and predicates."""

from pyspark.sql import functions as F

from bandwise.functions.arithmetic import floor_divide, floor_divide_real, modulo, power, ratio
from bandwise.functions.predicates import (
    above_population,
    all_of,
    between_chain,
    compare,
    either,
    keep,
)
from bandwise.operators.outliers import OutlierRule, OutlierSpec, outlier_rules
from bandwise.operators.summarize import prepare
from catalog.data import loans, rounded, table
from catalog.registry import query

KEYS = ["l_orderkey", "l_linenumber", "l_quantity"]

_NULLABLE = "CASE WHEN l_tax > 0 THEN l_tax END"


def _items(spark, sf_dir):
    """Items whose tax is null where it is zero."""
    return table(spark, sf_dir, "lineitem").withColumn(
        "tax", F.when(F.col("l_tax") > 0, F.col("l_tax"))
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 5 AND l_tax > 0.07"
)
def filter_rows(spark, sf_dir):
    """Null tax is not above the limit: null drops the row."""
    return keep(_items(spark, sf_dir), "l_quantity < 5", F.col("tax") > 0.07).select(*KEYS)


@query(
    """
    WITH m AS (SELECT l_quantity AS mode FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM lineitem, m
    WHERE l_returnflag = 'A' AND l_discount >= 0.05
      AND NOT (l_quantity > 45 AND l_quantity <> mode) AND NOT (l_extendedprice < 2000)
    """
)
def combined_filters_and_rules(spark, sf_dir):
    rows = loans(spark, sf_dir)
    rules = [
        *outlier_rules(rows, [OutlierSpec("l_quantity", ">", value=45)]),
        OutlierRule("l_extendedprice", "<", 2000),
    ]
    kept = keep(rows, all_of(["l_returnflag = 'A'", "l_discount >= 0.05", *(r.keeps() for r in rules)]))
    return kept.agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2).alias("price"))


@query("SELECT count(*) AS n FROM lineitem")
def combined_filters_none(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(all_of([])).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
    SELECT CAST(count_if(l_quantity = 7) AS BIGINT) AS eq, CAST(count_if(l_quantity <> 7) AS BIGINT) AS ne,
      CAST(count_if(l_quantity < 7) AS BIGINT) AS lt, CAST(count_if(l_quantity <= 7) AS BIGINT) AS le,
      CAST(count_if(l_returnflag > 'A') AS BIGINT) AS gt,
      CAST(count_if(({_NULLABLE}) >= 0.05) AS BIGINT) AS ge
    FROM lineitem
    """
)
def comparisons(spark, sf_dir):
    df = _items(spark, sf_dir)
    return df.agg(
        F.count_if(compare(df, "l_quantity", "==", 7)).alias("eq"),
        F.count_if(compare(df, "l_quantity", "!=", 7)).alias("ne"),
        F.count_if(compare(df, "l_quantity", "<", 7)).alias("lt"),
        F.count_if(compare(df, "l_quantity", "<=", 7)).alias("le"),
        F.count_if(compare(df, "l_returnflag", ">", "A")).alias("gt"),
        F.count_if(compare(df, "tax", ">=", 0.05)).alias("ge"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE 10 < l_quantity AND l_quantity <= 12 AND 12 < l_linenumber * 4
    """
)
def chained_comparison(spark, sf_dir):
    chain = between_chain(F.lit(10), "<", F.col("l_quantity"), "<=", F.lit(12), "<", F.col("l_linenumber") * 4)
    return keep(table(spark, sf_dir, "lineitem"), chain).select(*KEYS)


@query(
    f"""
    SELECT CAST(count_if(l_linenumber IN (1, 3)) AS BIGINT) AS inside,
      CAST(count_if(l_returnflag NOT IN ('A', 'R')) AS BIGINT) AS outside,
      CAST(count_if(({_NULLABLE}) NOT IN (0.01, 0.02)) AS BIGINT) AS null_outside
    FROM lineitem
    """
)
def membership(spark, sf_dir):
    return _items(spark, sf_dir).agg(
        F.count_if(F.col("l_linenumber").isin(1, 3)).alias("inside"),
        F.count_if(~F.col("l_returnflag").isin("A", "R")).alias("outside"),
        F.count_if(~F.col("tax").isin(0.01, 0.02)).alias("null_outside"),
    )


@query(
    f"""
    SELECT CAST(count_if(a AND b) AS BIGINT) AS both, CAST(count_if(a OR b) AS BIGINT) AS any_of,
      CAST(count_if(NOT b) AS BIGINT) AS negated, CAST(count_if(a <> b) AS BIGINT) AS exclusive
    FROM (SELECT l_quantity > 25 AS a, ({_NULLABLE}) > 0.04 AS b FROM lineitem)
    """
)
def boolean_logic(spark, sf_dir):
    a, b = F.col("l_quantity") > 25, F.col("tax") > 0.04
    return _items(spark, sf_dir).agg(
        F.count_if(a & b).alias("both"),
        F.count_if(a | b).alias("any_of"),
        F.count_if(~b).alias("negated"),
        F.count_if(either(a, b)).alias("exclusive"),
    )


@query(
    f"""
    SELECT l_returnflag, CAST(count_if(t IS NULL) AS BIGINT) AS missing,
      CAST(count_if(t IS NOT NULL) AS BIGINT) AS present
    FROM (SELECT l_returnflag, {_NULLABLE} AS t FROM lineitem) GROUP BY 1
    """
)
def null_tests(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("l_returnflag").agg(
        F.count_if(F.col("tax").isNull()).alias("missing"),
        F.count_if(F.col("tax").isNotNull()).alias("present"),
    )


@query(
    """
    SELECT d, z, count(*) AS n,
      CASE WHEN isnan(q) THEN 'nan' WHEN isinf(q) AND q > 0 THEN 'inf'
           WHEN isinf(q) THEN '-inf' ELSE CAST(round(q, 4) AS VARCHAR) END AS quotient,
      CAST(d - 5 - floor((d - 5) / 3.0) * 3 AS INT) AS mod_pos,
      CAST(d - 5 - floor((d - 5) / -3.0) * -3 AS INT) AS mod_neg,
      CAST(floor((d - 5) / 3.0) AS BIGINT) AS div_pos, CAST(floor((d - 5) / -3.0) AS BIGINT) AS div_neg,
      floor((d - 5) / 0.7) AS div_real, power(d, 2.0) AS squared
    FROM (SELECT d, z, CASE WHEN z <> 0 THEN (d - 5.0) / z WHEN d > 5 THEN 'inf'::DOUBLE
                 WHEN d < 5 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END AS q
          FROM (SELECT CAST(round(l_discount * 100) AS INT) AS d, CAST(round(l_tax * 100) AS INT) % 4 AS z
                FROM lineitem))
    GROUP BY ALL
    """
)
def arithmetic(spark, sf_dir):
    """True division by zero gives inf or NaN; remainders follow the divisor's sign."""
    d, z = F.col("d"), F.col("z")
    q = ratio(d - 5, z)
    shown = (
        F.when(F.isnan(q), "nan").when(q == float("inf"), "inf").when(q == float("-inf"), "-inf")
        .otherwise(F.round(q, 4).cast("string"))
    )
    rows = loans(spark, sf_dir).select(
        F.col("discount_pct").alias("d"), (F.col("tax_pct") % 4).alias("z")
    )
    return rows.select(
        "d", "z", shown.alias("quotient"),
        modulo(d - 5, F.lit(3)).cast("int").alias("mod_pos"),
        modulo(d - 5, F.lit(-3)).cast("int").alias("mod_neg"),
        floor_divide(d - 5, F.lit(3)).alias("div_pos"),
        floor_divide(d - 5, F.lit(-3)).alias("div_neg"),
        floor_divide_real(d - 5, F.lit(0.7)).alias("div_real"),
        power(d, F.lit(2)).alias("squared"),
    ).groupBy("d", "z", "quotient", "mod_pos", "mod_neg", "div_pos", "div_neg", "div_real", "squared").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """
    SELECT CAST(count_if(regexp_matches(c_name, '0[13]+5')) AS BIGINT) AS matching,
      CAST(count_if(starts_with(c_mktsegment, 'MA')) AS BIGINT) AS prefixed,
      CAST(count_if(ends_with(c_name, '7')) AS BIGINT) AS suffixed
    FROM customer
    """
)
def text_predicates(spark, sf_dir):
    """The first is a regular expression, the others are literal."""
    return table(spark, sf_dir, "customer").agg(
        F.count_if(F.col("c_name").rlike("0[13]+5")).alias("matching"),
        F.count_if(F.col("c_mktsegment").startswith("MA")).alias("prefixed"),
        F.count_if(F.col("c_name").endswith("7")).alias("suffixed"),
    )


@query(
    f"""
    SELECT l_returnflag, CAST(count_if(l_quantity BETWEEN 10 AND 20) AS BIGINT) AS between_n,
      round(sum(round(l_extendedprice)), 2) AS rounded, round(sum(floor(l_extendedprice)), 2) AS floored,
      round(sum(ceil(l_extendedprice)), 2) AS ceiled,
      round(sum(least(greatest(l_quantity, 5), 40)), 2) AS clipped,
      round(sum(coalesce({_NULLABLE}, 0.5)), 4) AS filled, round(sum(abs(l_quantity - 25)), 2) AS distance,
      max(lower(l_returnflag)) AS lowered, max(upper(l_linestatus)) AS raised,
      max(length(trim(' ' || l_linestatus))) AS width
    FROM lineitem GROUP BY 1
    """
)
def column_methods(spark, sf_dir):
    price = F.col("l_extendedprice")
    return _items(spark, sf_dir).groupBy("l_returnflag").agg(
        F.count_if(F.col("l_quantity").between(10, 20)).alias("between_n"),
        rounded(F.sum(F.round(price)), 2).alias("rounded"),
        rounded(F.sum(F.floor(price)), 2).alias("floored"),
        rounded(F.sum(F.ceil(price)), 2).alias("ceiled"),
        rounded(F.sum(F.least(F.greatest("l_quantity", F.lit(5)), F.lit(40))), 2).alias("clipped"),
        rounded(F.sum(F.coalesce("tax", F.lit(0.5))), 4).alias("filled"),
        rounded(F.sum(F.abs(F.col("l_quantity") - 25)), 2).alias("distance"),
        F.max(F.lower("l_returnflag")).alias("lowered"),
        F.max(F.upper("l_linestatus")).alias("raised"),
        F.max(F.length(F.trim(F.concat(F.lit(" "), "l_linestatus")))).cast("bigint").alias("width"),
    )


@query(
    """
    SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM lineitem WHERE l_extendedprice > (SELECT avg(l_extendedprice) FROM lineitem) GROUP BY 1
    """
)
def filter_by_population_aggregate(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    above = above_population(df, "l_extendedprice", F.avg("l_extendedprice"))
    return above.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(
    """
    SELECT size_class, count(*) AS n, round(sum(net), 2) AS net
    FROM (SELECT l_extendedprice * (1 - l_discount) AS net,
            CASE WHEN l_extendedprice * (1 - l_discount) > 50000 THEN 'large' ELSE 'small' END AS size_class
          FROM lineitem WHERE l_linenumber <> 2)
    GROUP BY 1
    """
)
def derived_columns_in_order(spark, sf_dir):
    """The second derived column uses the first."""
    rows = prepare(
        table(spark, sf_dir, "lineitem"),
        "l_linenumber <> 2",
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "size_class": "CASE WHEN net > 50000 THEN 'large' ELSE 'small' END",
        },
    )
    return rows.groupBy("size_class").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("net"), 2).alias("net")
    )


@query(
    """
    SELECT CAST(l_linenumber AS VARCHAR) AS line, count(*) AS n,
      round(sum(CAST(l_linenumber AS DOUBLE) / 2), 2) AS halves
    FROM lineitem GROUP BY 1
    """
)
def casts(spark, sf_dir):
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linenumber").cast("string").alias("line"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            rounded(F.sum(F.col("l_linenumber").cast("double") / 2), 2).alias("halves"),
        )
    )
