"""Information Value, outliers, distributions."""

from pyspark.sql import functions as F

from bandwise.operators.bands import numeric_range
from bandwise.operators.information_value import (
    check_binary,
    eligible_variables,
    information_value,
    iv_ranking,
    quantile_bins,
)
from bandwise.operators.outliers import (
    OutlierSpec,
    mode_value,
    outlier_counts,
    outlier_rule,
    outlier_rules,
)
from bandwise.operators.profile import (
    box_plot,
    distinct_values,
    distribution_profile,
    filter_impact,
    quantile_table,
)
from catalog.data import LOANS, loans, round_columns, rounded, table
from catalog.registry import query


def iv_sql(rows: str, target: str, numeric: list[str], text: list[str]) -> str:
    """IV of several variables: one subquery per variable."""
    parts = []
    for c in numeric:
        edges = ", ".join(f"{i}/20.0" for i in range(1, 20))
        parts.append(
            f"SELECT '{c}' AS variable, CAST(len(list_filter(list_distinct(e), lambda q: q < CAST({c} AS DOUBLE))) AS VARCHAR) AS bin, "
            f"{target} AS target FROM {rows}, (SELECT quantile_cont(CAST({c} AS DOUBLE), [{edges}]) AS e "
            f"FROM {rows} WHERE {target} IS NOT NULL) WHERE {c} IS NOT NULL AND {target} IS NOT NULL"
        )
    for c in text:
        parts.append(
            f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS bin, {target} AS target FROM {rows} "
            f"WHERE {c} IS NOT NULL AND {target} IS NOT NULL"
        )
    return f"""
    long AS ({' UNION ALL '.join(parts)}),
    bins AS (SELECT variable, bin, count_if(target = 0) AS good, count_if(target = 1) AS bad
             FROM long GROUP BY 1, 2),
    shares AS (SELECT variable,
        greatest(good / sum(good) OVER (PARTITION BY variable), 1e-6) AS g,
        greatest(bad / sum(bad) OVER (PARTITION BY variable), 1e-6) AS b FROM bins),
    ivs AS (SELECT variable, sum((g - b) * ln(g / b)) AS iv FROM shares GROUP BY 1)
    """


_STRENGTH = """CASE WHEN iv < 0.02 THEN 'useless' WHEN iv < 0.1 THEN 'weak'
      WHEN iv < 0.3 THEN 'medium' ELSE 'strong' END"""


@query(
    f"""
    WITH {LOANS}, {iv_sql('loans', 'bad', ['l_extendedprice'], [])}
    SELECT variable, round(iv, 6) AS iv, {_STRENGTH} AS strength FROM ivs
    """
)
def information_value_of_one_variable(spark, sf_dir):
    found = information_value(loans(spark, sf_dir), "l_extendedprice", "bad")
    return round_columns(found.select("variable", "iv", "strength"), 6, "iv")


@query(
    f"""
    WITH {LOANS}, f AS (SELECT * FROM loans WHERE l_quantity > 2),
    {iv_sql('f', 'bad', ['l_quantity', 'l_extendedprice', 'discount_pct', 'loss'], ['l_linestatus', 'l_returnflag'])}
    SELECT variable, round(iv, 6) AS iv, {_STRENGTH} AS strength FROM ivs
    """
)
def iv_ranking_of_loans(spark, sf_dir):
    """All variables in shared passes; the order itself is not compared."""
    variables = ["l_quantity", "l_extendedprice", "discount_pct", "loss", "l_linestatus", "l_returnflag"]
    found = iv_ranking(loans(spark, sf_dir), "bad", variables, where="l_quantity > 2")
    return round_columns(found.select("variable", "iv", "strength"), 6, "iv")


@query(
    f"""
    WITH docs AS (SELECT quality, toxic, n_chars, lang, source FROM documents JOIN labels USING (doc_id)),
    {iv_sql('docs', 'quality', ['n_chars', 'toxic'], ['lang', 'source'])},
    counted AS (SELECT 'lang' AS variable, count(DISTINCT lang) AS n FROM docs
      UNION ALL SELECT 'source', count(DISTINCT source) FROM docs)
    SELECT variable, CASE WHEN n > 10 THEN NULL ELSE round(iv, 6) END AS iv,
      CASE WHEN n > 10 THEN NULL ELSE {_STRENGTH} END AS strength,
      CASE WHEN n > 10 THEN 'more than 10 values' END AS reason
    FROM ivs LEFT JOIN counted USING (variable)
    """
)
def iv_ranking_of_documents(spark, sf_dir):
    """``source`` has more than ten values: its row gives the reason why it has no rank."""
    docs = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id")
    found = iv_ranking(docs, "quality", ["n_chars", "toxic", "lang", "source"])
    return round_columns(found.drop("n_values"), 6, "iv")


@query(
    f"""
    WITH {LOANS}, {iv_sql('loans', 'bad', ['l_extendedprice'], [])}
    SELECT variable, round(iv, 6) AS iv, {_STRENGTH} AS strength FROM ivs
    """
)
def information_value_in_ranges(spark, sf_dir):
    """With bin edges found through parallel ranges."""
    found = information_value(loans(spark, sf_dir), "l_extendedprice", "bad", limit=1000)
    return round_columns(found.select("variable", "iv", "strength"), 6, "iv")


_EDGES = ", ".join(f"{i}/8.0" for i in range(1, 8))


@query(
    f"""
    SELECT CAST(len(list_filter(list_distinct(e), lambda q: q < l_extendedprice)) AS INT) AS bin,
      count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, [{_EDGES}]) AS e FROM lineitem)
    GROUP BY 1
    """
)
def quantile_binning(spark, sf_dir):
    binned = quantile_bins(table(spark, sf_dir, "lineitem"), "l_extendedprice", "bin", 8)
    return binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )


@query(
    f"""
    WITH {LOANS}
    SELECT 'bad' AS target, count_if(bad NOT IN (0, 1)) = 0 AS is_binary FROM loans
    UNION ALL SELECT 'l_linenumber', count_if(l_linenumber NOT IN (0, 1)) = 0 FROM loans
    """
)
def binary_target_check(spark, sf_dir):
    rows = loans(spark, sf_dir)
    return (
        check_binary(rows, "bad").withColumn("target", F.lit("bad"))
        .unionByName(check_binary(rows, "l_linenumber").withColumn("target", F.lit("l_linenumber")))
    )


@query(
    """
    SELECT 'c_mktsegment' AS variable, count(DISTINCT c_mktsegment) <= 10 AS usable FROM customer
    UNION ALL SELECT 'c_name', count(DISTINCT c_name) <= 10 FROM customer
    UNION ALL SELECT 'c_acctbal', TRUE
    """
)
def variables_fit_for_ranking(spark, sf_dir):
    """Text variables with more than ten values are left out; numbers never are."""
    customer = table(spark, sf_dir, "customer")
    usable, left_out = eligible_variables(customer, ["c_mktsegment", "c_name", "c_acctbal"])
    rows = [(c, True) for c in usable] + [(c, False) for c in left_out]
    return spark.createDataFrame(rows, "variable string, usable boolean")


_MODE = """m AS (SELECT {x} AS mode FROM {t} WHERE {x} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"""


@query(
    f"""
    WITH {LOANS}, {_MODE.format(x='l_quantity', t='loans')} SELECT mode FROM m
    """
)
def most_frequent_value(spark, sf_dir):
    mode = mode_value(loans(spark, sf_dir), "l_quantity")
    return spark.createDataFrame([(mode,)], "mode double")


@query(
    f"""
    WITH {LOANS}, {_MODE.format(x='loss', t='loans')}
    SELECT 'loss' AS variable, any_value(mode) AS mode, round(any_value(threshold), 4) AS threshold,
      count_if(loss > threshold AND loss <> mode) AS outliers,
      count_if(NOT (loss > threshold AND loss <> mode)) AS kept
    FROM loans, m, (SELECT quantile_cont(loss, 0.95) AS threshold FROM loans, m WHERE loss <> mode)
    """
)
def outlier_threshold(spark, sf_dir):
    """95th percentile of the loss, most of which is zero: zero is left out."""
    rows = loans(spark, sf_dir)
    rule = outlier_rule(rows, "loss", ">", percentile=95)
    return rows.agg(
        F.lit("loss").alias("variable"),
        F.lit(rule.mode).alias("mode"),
        rounded(F.lit(rule.threshold)).alias("threshold"),
        F.count_if(rule.is_outlier()).alias("outliers"),
        F.count_if(rule.keeps()).alias("kept"),
    )


@query(
    f"""
    WITH {LOANS}, {_MODE.format(x='l_quantity', t='loans')},
    t AS (SELECT quantile_cont(l_extendedprice, 0.99) AS p FROM loans, (
        SELECT l_extendedprice AS mp FROM loans GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        WHERE l_extendedprice <> mp),
    mp AS (SELECT l_extendedprice AS mp FROM loans GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    h AS (SELECT l_quantity < 3 AND l_quantity <> mode AS a,
            l_extendedprice >= p AND l_extendedprice <> mp AS b FROM loans, m, t, mp)
    SELECT 1 AS position, count_if(a) AS outliers FROM h
    UNION ALL SELECT 2, count_if(b) FROM h UNION ALL SELECT 3, count_if(a OR b) FROM h
    """
)
def outlier_counts_per_rule(spark, sf_dir):
    rows = loans(spark, sf_dir)
    rules = outlier_rules(
        rows,
        [
            OutlierSpec("l_quantity", "<", value=3),
            OutlierSpec("l_extendedprice", ">=", percentile=99),
        ],
    )
    counts = outlier_counts(rows, rules)
    position = (
        F.when(F.col("rule").startswith("l_quantity"), 1)
        .when(F.col("rule").startswith("l_extendedprice"), 2)
        .otherwise(3)
    )
    return counts.select(position.alias("position"), "outliers").withColumn(
        "outliers", F.col("outliers").cast("bigint")
    )


@query(
    f"""
    WITH {LOANS}, {_MODE.format(x='loss', t='loans')},
    v(fraction, label) AS (VALUES (0.25::DOUBLE, '25.0%'), (0.5, '50.0%'), (0.75, '75.0%'), (0.9, '90.0%'),
      (0.95, '95.0%'), (0.99, '99.0%'))
    SELECT fraction, label AS percentile, round(CASE fraction WHEN 0.25 THEN q[1] WHEN 0.5 THEN q[2]
        WHEN 0.75 THEN q[3] WHEN 0.9 THEN q[4] WHEN 0.95 THEN q[5] ELSE q[6] END, 4) AS value
    FROM v, (SELECT quantile_cont(loss, [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS q FROM loans, m WHERE loss <> mode)
    """
)
def distribution_of_a_skewed_variable(spark, sf_dir):
    """Loss is right-skewed: percentiles of the upper tail."""
    found = distribution_profile(loans(spark, sf_dir), "loss")
    return found.select("fraction", "percentile", rounded("value").alias("value"))


@query(
    f"""
    WITH {LOANS}, {_MODE.format(x='l_extendedprice', t='loans')}
    SELECT 'l_extendedprice' AS variable, round(q[1], 4) AS "10th Percentile",
      round(q[2], 4) AS "50th Percentile", round(q[3], 4) AS "90th Percentile"
    FROM (SELECT quantile_cont(l_extendedprice, [0.1, 0.5, 0.9]) AS q FROM loans, m WHERE l_extendedprice <> mode)
    """
)
def table_of_quantiles(spark, sf_dir):
    found = quantile_table(loans(spark, sf_dir), "l_extendedprice", [0.1, 0.5, 0.9])
    return round_columns(found, 4, "10th Percentile", "50th Percentile", "90th Percentile")


@query(
    f"""
    WITH {LOANS}, q AS (SELECT quantile_cont(loss, [0.25, 0.5, 0.75]) AS q FROM loans WHERE bad = 1)
    SELECT count(*) AS n, min(loss) AS minimum, round(any_value(q[1]), 4) AS q1, round(any_value(q[2]), 4) AS median,
      round(any_value(q[3]), 4) AS q3, round(max(loss), 4) AS maximum,
      round(min(loss) FILTER (loss >= q[1] - 1.5 * (q[3] - q[1])), 4) AS whisker_low,
      round(max(loss) FILTER (loss <= q[3] + 1.5 * (q[3] - q[1])), 4) AS whisker_high,
      CAST(count_if(loss < q[1] - 1.5 * (q[3] - q[1]) OR loss > q[3] + 1.5 * (q[3] - q[1])) AS BIGINT) AS outliers
    FROM loans, q WHERE bad = 1
    """
)
def box_plot_statistics(spark, sf_dir):
    found = box_plot(loans(spark, sf_dir).filter("bad = 1"), "loss")
    return round_columns(found, 4, "q1", "median", "q3", "maximum", "whisker_low", "whisker_high")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL")
def distinct_values_of_a_column(spark, sf_dir):
    return distinct_values(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    """
    SELECT 'l_quantity' AS variable, min(l_quantity) AS minimum, max(l_quantity) AS maximum FROM lineitem
    UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), max(l_extendedprice) FROM lineitem
    """
)
def range_of_variables(spark, sf_dir):
    return numeric_range(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


@query(
    """
    SELECT 'taxed' AS filter, count_if(t > 0.04) AS satisfied, count_if(NOT t > 0.04) AS failed
    FROM (SELECT CASE WHEN l_tax > 0 THEN l_tax END AS t FROM lineitem)
    UNION ALL SELECT 'large', count_if(l_quantity > 40), count_if(NOT l_quantity > 40) FROM lineitem
    """
)
def impact_of_filters(spark, sf_dir):
    """Rows with a null tax are in neither count."""
    rows = table(spark, sf_dir, "lineitem").withColumn("t", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    found = filter_impact(rows, {"taxed": "t > 0.04", "large": F.col("l_quantity") > 40})
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("satisfied", "failed")})
