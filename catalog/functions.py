"""Scalar functions: math, row-wise summaries, labels and formats."""

from pyspark.sql import functions as F

from bandwise.functions.arithmetic import ln, log1p, log10
from bandwise.functions.labels import (
    format_value,
    label_codes,
    percentile_label,
    quantile_label,
)
from bandwise.functions.rowwise import row_max, row_mean, row_median, row_min, row_std, row_sum
from catalog.data import loans, rounded, table
from catalog.registry import query


def _sums(df, **expressions):
    """Per line number: the sum of each expression, rounded."""
    return df.groupBy("l_linenumber").agg(
        *(rounded(F.sum(e), 4).alias(name) for name, e in expressions.items())
    )


@query(
    """
    SELECT l_linenumber, round(sum(sin(l_tax)), 4) AS sin_x, round(sum(cos(l_tax)), 4) AS cos_x,
      round(sum(sinh(l_tax)), 4) AS sinh_x, round(sum(cosh(l_tax)), 4) AS cosh_x,
      round(sum(tanh(l_tax)), 4) AS tanh_x
    FROM lineitem GROUP BY 1
    """
)
def trigonometric(spark, sf_dir):
    x = F.col("l_tax")
    return _sums(
        table(spark, sf_dir, "lineitem"),
        sin_x=F.sin(x), cos_x=F.cos(x), sinh_x=F.sinh(x), cosh_x=F.cosh(x), tanh_x=F.tanh(x),
    )


@query(
    """
    SELECT l_linenumber, round(sum(asin(l_discount)), 4) AS asin_x, round(sum(acos(l_discount)), 4) AS acos_x,
      round(sum(atan(l_quantity)), 4) AS atan_x, round(sum(asinh(l_quantity)), 4) AS asinh_x,
      round(sum(acosh(l_quantity)), 4) AS acosh_x, round(sum(atanh(l_discount)), 4) AS atanh_x,
      round(sum(atan2(l_quantity - 25, l_discount - 0.05)), 4) AS atan2_yx
    FROM lineitem GROUP BY 1
    """
)
def inverse_trigonometric(spark, sf_dir):
    d, q = F.col("l_discount"), F.col("l_quantity")
    return _sums(
        table(spark, sf_dir, "lineitem"),
        asin_x=F.asin(d), acos_x=F.acos(d), atan_x=F.atan(q), asinh_x=F.asinh(q),
        acosh_x=F.acosh(q), atanh_x=F.atanh(d), atan2_yx=F.atan2(q - 25, d - 0.05),
    )


@query(
    """
    SELECT l_linenumber, round(sum(exp(l_tax)), 4) AS exp_x, round(sum(exp(l_tax) - 1), 4) AS expm1_x,
      round(sum(sqrt(l_quantity)), 4) AS sqrt_x, round(sum(abs(l_quantity - 20)), 4) AS abs_x
    FROM lineitem GROUP BY 1
    """
)
def exponentials_and_roots(spark, sf_dir):
    t, q = F.col("l_tax"), F.col("l_quantity")
    return _sums(
        table(spark, sf_dir, "lineitem"),
        exp_x=F.exp(t), expm1_x=F.expm1(t), sqrt_x=F.sqrt(q), abs_x=F.abs(q - 20),
    )


@query(
    """
    SELECT x, count(*) AS n,
      CASE WHEN x < 0 THEN 'nan' WHEN x = 0 THEN '-inf' ELSE CAST(round(ln(x), 4) AS VARCHAR) END AS ln_x,
      CASE WHEN x < 0 THEN 'nan' WHEN x = 0 THEN '-inf' ELSE CAST(round(log10(x), 4) AS VARCHAR) END AS log10_x,
      CASE WHEN x < -1 THEN 'nan' WHEN x = -1 THEN '-inf' ELSE CAST(round(ln(1 + x), 4) AS VARCHAR) END AS log1p_x
    FROM (SELECT round(l_discount * 100) - 3 AS x FROM lineitem) GROUP BY x
    """
)
def logarithms(spark, sf_dir):
    """Zero and negative arguments included."""
    x = F.col("x")

    def shown(c):
        return (
            F.when(F.isnan(c), "nan").when(c == float("-inf"), "-inf")
            .otherwise(F.round(c, 4).cast("string"))
        )

    values = loans(spark, sf_dir).groupBy((F.round(F.col("l_discount") * 100) - 3).alias("x")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return values.select(
        "x", "n", shown(ln(x)).alias("ln_x"), shown(log10(x)).alias("log10_x"),
        shown(log1p(x)).alias("log1p_x"),
    )


@query(
    """
    SELECT l_linenumber, round(sum(s), 4) AS row_sum, round(sum(CASE WHEN n > 0 THEN s / n END), 4) AS row_mean,
      round(sum(list_median(v)), 4) AS row_median, round(sum(list_min(v)), 4) AS row_min,
      round(sum(list_max(v)), 4) AS row_max,
      round(sum(CASE WHEN n > 1 THEN list_stddev_samp(v) END), 4) AS row_std
    FROM (SELECT l_linenumber, v, len(v) AS n, coalesce(list_sum(v), 0) AS s
          FROM (SELECT l_linenumber, list_filter([l_quantity, CASE WHEN l_tax > 0.02 THEN l_tax * 100 END,
                  CASE WHEN l_discount > 0.03 THEN l_discount * 100 END, CAST(l_linenumber AS DOUBLE)],
                  lambda x: x IS NOT NULL) AS v FROM lineitem))
    GROUP BY 1
    """
)
def row_wise_summaries(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns(
        {
            "t": F.when(F.col("l_tax") > 0.02, F.col("l_tax") * 100),
            "d": F.when(F.col("l_discount") > 0.03, F.col("l_discount") * 100),
        }
    )
    c = ["l_quantity", "t", "d", "l_linenumber"]
    return _sums(
        df, row_sum=row_sum(*c), row_mean=row_mean(*c), row_median=row_median(*c),
        row_min=row_min(*c), row_max=row_max(*c), row_std=row_std(*c),
    )


@query(
    """
    SELECT l_returnflag, count(*) AS n, CAST(count(missing) AS BIGINT) AS missing,
      CAST(count_if(yes) AS BIGINT) AS yes
    FROM (SELECT l_returnflag, NULL AS missing, TRUE AS yes FROM lineitem) GROUP BY 1
    """
)
def literals(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns(
        {"missing": F.lit(None).cast("double"), "yes": F.lit(True)}
    )
    return df.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("missing").alias("missing"), F.count_if("yes").alias("yes")
    )


@query(
    """
    SELECT CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' END AS label,
      count(*) AS n
    FROM lineitem GROUP BY 1
    """
)
def codes_to_labels(spark, sf_dir):
    label = label_codes(F.col("l_linenumber"), {1: "first", 2: "second", 3: "third"})
    return table(spark, sf_dir, "lineitem").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT l_linenumber, format('{:,}', count(*)) AS volume,
      printf('%.1f', CAST(sum(l_linenumber) AS DOUBLE)) || '%' AS share,
      CAST(NULL AS VARCHAR) AS nothing
    FROM lineitem GROUP BY 1
    """
)
def number_formats(spark, sf_dir):
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(
        format_value(n, decimals=0).alias("volume"),
        format_value(F.sum("l_linenumber"), decimals=1, thousands=False, percentage=True).alias("share"),
        format_value(F.lit(None).cast("double")).alias("nothing"),
    )


@query(
    """
    SELECT l_discount, printf('%.1f', l_discount * 100) || '%' AS percentile,
      printf('%.0f', l_discount * 100) || 'th Percentile' AS title, count(*) AS n
    FROM lineitem GROUP BY l_discount
    """
)
def percentile_labels(spark, sf_dir):
    values = table(spark, sf_dir, "lineitem").groupBy("l_discount").agg(F.count(F.lit(1)).alias("n"))
    return values.select(
        "l_discount", percentile_label(F.col("l_discount")).alias("percentile"),
        quantile_label(F.col("l_discount")).alias("title"), "n",
    )
