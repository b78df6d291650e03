"""Aggregates, standard metrics and grouped summaries."""

from pyspark.sql import functions as F

from bandwise.operators import metrics as M
from bandwise.operators.ordering import null_safe_join
from bandwise.operators.quantiles import group_quantiles
from bandwise.operators.summarize import LEVEL, cumulative, join_summaries, summarize, summarize_levels
from bandwise.sources.union import only_sources
from catalog.data import LOANS, loans, portfolio, round_columns, rounded, table
from catalog.registry import query

# Every ordering column, so that ties are exact copies.
ROW_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]

_TAX = "CASE WHEN l_tax > 0 THEN l_tax END"


def _items(spark, sf_dir):
    return loans(spark, sf_dir).withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))


@query(
    f"""
    SELECT l_returnflag, round(sum(l_quantity), 2) AS total_q, round(avg(t), 6) AS mean_t,
      min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(count(t) AS BIGINT) AS count_t,
      count(*) AS size, round(coalesce(sum(CASE WHEN t > 1 THEN t END), 0), 2) AS empty_sum
    FROM (SELECT *, {_TAX} AS t FROM lineitem) GROUP BY 1
    """
)
def basic_aggregates(spark, sf_dir):
    nothing = F.when(F.col("tax") > 1, F.col("tax"))
    found = summarize(
        _items(spark, sf_dir),
        ["l_returnflag"],
        [
            M.total("total_q", "l_quantity"),
            M.mean("mean_t", "tax"),
            M.smallest("low", "l_extendedprice"),
            M.largest("high", "l_extendedprice"),
            M.value_count("count_t", "tax"),
            M.row_count("size"),
            M.total("empty_sum", nothing),
        ],
    )
    return round_columns(round_columns(found, 2, "total_q", "empty_sum"), 6, "mean_t")


@query(
    f"""
    SELECT l_linenumber, round(stddev_samp(t), 6) AS std_t, round(var_samp(l_quantity), 6) AS var_q,
      round(avg(power(l_quantity - m, 3)) / power(avg(power(l_quantity - m, 2)), 1.5), 6) AS skew_q,
      round(avg(power(l_quantity - m, 4)) / power(avg(power(l_quantity - m, 2)), 2) - 3, 6) AS kurt_q,
      round(stddev_samp(t) / sqrt(count(t)), 8) AS sem_t,
      round(covar_samp(l_quantity, l_extendedprice), 2) AS cov_qp,
      round(corr(l_quantity, l_tax), 6) AS corr_qt,
      round(product(1 + l_discount / 1000), 6) AS prod_d
    FROM (SELECT *, {_TAX} AS t, avg(l_quantity) OVER (PARTITION BY l_linenumber) AS m FROM lineitem)
    GROUP BY 1
    """
)
def moments(spark, sf_dir):
    found = summarize(
        _items(spark, sf_dir),
        ["l_linenumber"],
        [
            M.std("std_t", "tax"),
            M.variance("var_q", "l_quantity"),
            M.skewness("skew_q", "l_quantity"),
            M.kurtosis("kurt_q", "l_quantity"),
            M.standard_error("sem_t", "tax"),
            M.covariance("cov_qp", "l_quantity", "l_extendedprice"),
            M.correlation("corr_qt", "l_quantity", "l_tax"),
            M.product("prod_d", 1 + F.col("l_discount") / 1000),
        ],
    )
    found = round_columns(found, 6, "std_t", "var_q", "skew_q", "kurt_q", "corr_qt", "prod_d")
    return round_columns(round_columns(found, 8, "sem_t"), 2, "cov_qp")


@query(
    f"""
    SELECT l_returnflag, CAST(count(DISTINCT t) + max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_tax,
      CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_part
    FROM (SELECT *, {_TAX} AS t FROM lineitem) GROUP BY 1
    """
)
def distinct_counts(spark, sf_dir):
    """Null counts as one value."""
    return summarize(
        _items(spark, sf_dir),
        ["l_returnflag"],
        [M.distinct_count("n_tax", "tax"), M.distinct_count("n_part", "l_partkey")],
    )


@query(
    """
    SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS n_part, true AS within_bound
    FROM lineitem GROUP BY 1
    """
)
def distinct_counts_approximate(spark, sf_dir):
    """The exact count, and whether the sketch is within three of its standard errors (5 %) of it."""
    found = summarize(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"],
        [
            M.distinct_count("n_part", "l_partkey"),
            M.distinct_count("about", "l_partkey", approximate=True),
        ],
    )
    off = F.abs(F.col("about") - F.col("n_part"))
    return found.select("l_returnflag", "n_part", (off <= 0.15 * F.col("n_part")).alias("within_bound"))


@query(
    """
    SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS median_price,
      quantile_cont(l_quantity, 0.5) AS median_q
    FROM lineitem GROUP BY 1
    """
)
def medians(spark, sf_dir):
    return summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        [M.median("median_price", "l_extendedprice"), M.median("median_q", "l_quantity")],
    )


_MODE_SQL = """
    SELECT l_linenumber, {x} AS mode_x FROM (
      SELECT l_linenumber, {x}, row_number() OVER (PARTITION BY l_linenumber ORDER BY count(*) DESC, {x}) AS k
      FROM lineitem GROUP BY 1, 2) WHERE k = 1
    """


@query(_MODE_SQL.format(x="l_quantity"))
def modes(spark, sf_dir):
    return summarize(
        table(spark, sf_dir, "lineitem"), ["l_linenumber"], [M.mode("mode_x", "l_quantity")]
    )


@query(
    """
    SELECT l_linestatus, round(q[1], 4) AS p10, round(q[2], 4) AS p50, round(q[3], 4) AS p99
    FROM (SELECT l_linestatus, quantile_cont(l_extendedprice, [0.1, 0.5, 0.99]) AS q
          FROM lineitem GROUP BY 1)
    """
)
def linear_quantiles(spark, sf_dir):
    found = group_quantiles(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99], ["l_linestatus"]
    )
    q = F.col("quantiles")
    return found.select(
        "l_linestatus", rounded(q[0]).alias("p10"), rounded(q[1]).alias("p50"), rounded(q[2]).alias("p99")
    )


@query(
    """
    SELECT l_linestatus, round(q[1], 4) AS p10, round(q[2], 4) AS p50, round(q[3], 4) AS p99
    FROM (SELECT l_linestatus, quantile_cont(l_extendedprice, [0.1, 0.5, 0.99]) AS q
          FROM lineitem GROUP BY 1)
    """
)
def linear_quantiles_in_ranges(spark, sf_dir):
    """The same through parallel ranges, as for a column with too many values for one task."""
    found = group_quantiles(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.99], ["l_linestatus"],
        limit=1000,
    )
    q = F.col("quantiles")
    return found.select(
        "l_linestatus", rounded(q[0]).alias("p10"), rounded(q[1]).alias("p50"), rounded(q[2]).alias("p99")
    )


@query("SELECT l_linestatus, count(*) AS n, true AS within_bound FROM lineitem GROUP BY 1")
def approximate_quantiles(spark, sf_dir):
    """Whether the rank of the value found is off by no more than a share of 1 / accuracy of the rows."""
    items = table(spark, sf_dir, "lineitem")
    accuracy = 1000
    found = summarize(
        items, ["l_linestatus"], [M.approximate_quantile("p90", "l_extendedprice", 0.9, accuracy=accuracy)]
    )
    value = F.col("l_extendedprice")
    ranks = items.join(found, "l_linestatus").groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(value < F.col("p90")).alias("below"),
        F.count_if(value <= F.col("p90")).alias("upto"),
    )
    # One row more on either side, as ranks are whole numbers.
    low, high = F.col("n") * (0.9 - 1 / accuracy) - 1, F.col("n") * (0.9 + 1 / accuracy) + 1
    within = (F.col("below") <= high) & (F.col("upto") >= low)
    return ranks.select("l_linestatus", "n", within.alias("within_bound"))


_RANKED = """
    WITH r AS (
      SELECT l_returnflag, l_extendedprice AS x,
        row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k,
        (count(*) OVER (PARTITION BY l_returnflag) - 1) * 0.75::DOUBLE AS h
      FROM lineitem)
    SELECT l_returnflag, max(CASE WHEN k = floor(h + 0.5) THEN x END) AS nearest,
      max(CASE WHEN k = floor(h) THEN x END) AS lower_value, max(CASE WHEN k = ceil(h) THEN x END) AS higher_value,
      round((max(CASE WHEN k = floor(h) THEN x END) + max(CASE WHEN k = ceil(h) THEN x END)) / 2, 4) AS midpoint
    FROM r GROUP BY 1
    """


@query(_RANKED)
def quantile_interpolations(spark, sf_dir):
    found = summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        [
            M.quantile("nearest", "l_extendedprice", 0.75),
            M.quantile("lower_value", "l_extendedprice", 0.75, "lower"),
            M.quantile("higher_value", "l_extendedprice", 0.75, "higher"),
            M.quantile("midpoint", "l_extendedprice", 0.75, "midpoint"),
        ],
    )
    return round_columns(found, 4, "midpoint")


@query(
    f"""
    SELECT l_returnflag, round(corr(q, previous), 6) AS autocorr_q
    FROM (SELECT l_returnflag, l_quantity AS q,
            lag(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY {', '.join(ROW_ORDER)}) AS previous
          FROM lineitem)
    GROUP BY 1
    """
)
def autocorrelation(spark, sf_dir):
    found = summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        [M.autocorrelation("autocorr_q", "l_quantity", ROW_ORDER)],
    )
    return round_columns(found, 6, "autocorr_q")


@query(
    f"""
    SELECT l_returnflag, round(corr(q, previous), 6) AS autocorr_q
    FROM (SELECT l_returnflag, l_quantity AS q,
            lag(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY {', '.join(ROW_ORDER)}) AS previous
          FROM lineitem)
    GROUP BY 1
    """
)
def autocorrelation_in_ranges(spark, sf_dir):
    """The same with the order cut into parallel ranges."""
    found = summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_returnflag"],
        [M.autocorrelation("autocorr_q", "l_quantity", ROW_ORDER, limit=2000)],
    )
    return round_columns(found, 6, "autocorr_q")


@query(
    """
    SELECT l_orderkey % 50 AS bucket, bool_and(l_linenumber > 0) AS all_positive,
      bool_or(l_quantity = 50 AND l_tax = 0.08 AND l_discount = 0.1) AS any_extreme
    FROM lineitem GROUP BY 1
    """
)
def every_and_some(spark, sf_dir):
    extreme = (F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0.1)
    return summarize(
        table(spark, sf_dir, "lineitem"),
        ["bucket"],
        [M.every("all_positive", "l_linenumber"), M.some("any_extreme", extreme)],
        with_columns={"bucket": F.col("l_orderkey") % 50},
    )


@query(
    """
    SELECT l_linestatus, CAST(count_if(l_returnflag IN ('A', 'R')) AS BIGINT) AS n_in,
      CAST(count_if(l_quantity > 40) AS BIGINT) AS n_large
    FROM lineitem GROUP BY 1
    """
)
def conditional_counts(spark, sf_dir):
    return summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_linestatus"],
        [
            M.count_where("n_in", F.col("l_returnflag").isin("A", "R")),
            M.count_where("n_large", F.col("l_quantity") > 40),
        ],
    )


@query(
    """
    SELECT l_linestatus, round(sum(l_quantity * l_discount) / sum(l_quantity), 8) AS weighted,
      round((max(l_quantity) - min(l_quantity)) / avg(l_quantity), 6) AS spread
    FROM lineitem GROUP BY 1
    """
)
def arithmetic_over_aggregates(spark, sf_dir):
    q = F.col("l_quantity")
    found = summarize(
        table(spark, sf_dir, "lineitem"),
        ["l_linestatus"],
        [
            M.quotient("weighted", q * F.col("l_discount"), q),
            M.aggregate("spread", lambda c: (F.max(c) - F.min(c)) / F.avg(c), q),
        ],
    )
    return round_columns(round_columns(found, 8, "weighted"), 6, "spread")


@query(
    f"""
    WITH {LOANS}
    SELECT l_linenumber, count(*) AS volume, round(avg(bad) * 100 * 12 / 18, 4) AS unit_rate,
      round(sum(loss) / sum(balance) * 100 * 12 / 18, 4) AS dollar_rate
    FROM loans GROUP BY 1
    """
)
def annualised_bad_rates(spark, sf_dir):
    found = summarize(
        loans(spark, sf_dir),
        ["l_linenumber"],
        [
            M.volume("volume"),
            M.unit_bad_rate("unit_rate", "bad", mob=18),
            M.dollar_bad_rate("dollar_rate", "loss", "balance", mob=18),
        ],
    )
    return round_columns(found, 4, "unit_rate", "dollar_rate")


@query(
    f"""
    WITH {LOANS}
    SELECT l_linenumber, round(avg(bad) FILTER (source = 'test') * 100, 4) AS early_unit,
      round(sum(loss) FILTER (source = 'test') / sum(balance) FILTER (source = 'test') * 100, 4) AS early_dollar
    FROM loans GROUP BY 1
    """
)
def early_delinquency(spark, sf_dir):
    """Over the test source, without annualisation."""
    found = summarize(
        portfolio(spark, sf_dir),
        ["l_linenumber"],
        [
            M.unit_bad_rate("early_unit", "bad").on("test"),
            M.dollar_bad_rate("early_dollar", "loss", "balance").on("test"),
        ],
    )
    return round_columns(found, 4, "early_unit", "early_dollar")


@query(
    """
    SELECT o_orderpriority,
      round(count_if(o_orderstatus = 'F') / count_if(o_orderstatus IN ('F', 'O')), 6) AS approval,
      round(count_if(o_orderstatus = 'F') / (SELECT count(*) FROM orders WHERE o_totalprice > 50000), 6) AS overall
    FROM orders WHERE o_totalprice > 50000 GROUP BY 1
    """
)
def approval_rates(spark, sf_dir):
    """The overall rate is over all filtered rows, not those of the group."""
    found = summarize(
        table(spark, sf_dir, "orders"),
        ["o_orderpriority"],
        [
            M.approval_rate("approval", "o_orderstatus", ["F"], ["O"]),
            M.overall_approval_rate("overall", "o_orderstatus", ["F"]),
        ],
        where="o_totalprice > 50000",
    )
    return round_columns(found, 6, "approval", "overall")


@query(
    f"""
    WITH {LOANS}
    SELECT l_linestatus, round(avg(bad), 6) AS unit_rate, round(sum(loss) / sum(balance), 8) AS dollar_rate,
      CAST(NULL AS DOUBLE) AS unset
    FROM loans GROUP BY 1
    """
)
def plain_bad_rates(spark, sf_dir):
    found = summarize(
        loans(spark, sf_dir),
        ["l_linestatus"],
        [
            M.quotient("unit_rate", "bad", F.lit(1)),
            M.quotient("dollar_rate", "loss", "balance"),
            M.missing("unset"),
        ],
    )
    return round_columns(round_columns(found, 6, "unit_rate"), 8, "dollar_rate")


@query(
    f"""
    WITH {LOANS}
    SELECT key, heavy, count(*) AS volume, round(sum(balance), 2) AS balance
    FROM (SELECT *, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS key, l_quantity > 25 AS heavy
          FROM loans WHERE l_tax > 0.01)
    GROUP BY 1, 2
    """
)
def grouped_summary(spark, sf_dir):
    """Filter, derived keys, a null key as a group of its own."""
    found = summarize(
        loans(spark, sf_dir),
        ["key", "heavy"],
        [M.volume("volume"), M.total("balance", "balance")],
        where="l_tax > 0.01",
        with_columns={
            "key": F.when(F.col("l_linenumber") < 6, F.col("l_linenumber")),
            "heavy": "l_quantity > 25",
        },
    )
    return round_columns(found, 2, "balance")


_SOURCES_SQL = f"""
    WITH {LOANS}, k AS (
      SELECT *, CASE WHEN l_linenumber < 6 THEN l_linenumber END AS key FROM loans
      WHERE NOT (source = 'dev' AND l_linenumber = 1) AND NOT (source = 'test' AND l_linenumber = 2)),
    dev AS (SELECT key, count(*) AS n, sum(loss) / sum(balance) AS r FROM k WHERE source = 'dev' GROUP BY 1),
    tst AS (SELECT key, count(*) AS n FROM k WHERE source = 'test' GROUP BY 1)
    SELECT coalesce(d.key, t.key) AS key, d.n AS dev_volume, round(d.r * 100, 4) AS dev_rate, t.n AS test_volume
    FROM dev d FULL JOIN tst t ON d.key IS NOT DISTINCT FROM t.key
    WHERE coalesce(d.key, t.key) IS NOT NULL
    """
_SOURCES_WHERE = (
    "NOT (__source__ = 'dev' AND l_linenumber = 1) AND NOT (__source__ = 'test' AND l_linenumber = 2)"
)


def _source_key():
    return {"key": F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))}


@query(_SOURCES_SQL)
def summary_over_several_sources(spark, sf_dir):
    """Each metric over its own source, one scan; a group absent from a source is null there."""
    found = summarize(
        portfolio(spark, sf_dir),
        ["key"],
        [
            M.volume("dev_volume").on("dev"),
            M.dollar_bad_rate("dev_rate", "loss", "balance").on("dev"),
            M.volume("test_volume").on("test"),
        ],
        where=_SOURCES_WHERE,
        with_columns=_source_key(),
    )
    return round_columns(found, 4, "dev_rate")


@query(_SOURCES_SQL)
def summaries_joined_null_safe(spark, sf_dir):
    """The same from one summary per source, joined on keys that may be null."""
    rows = portfolio(spark, sf_dir)
    dev = summarize(
        only_sources(rows, ["dev"]), ["key"],
        [M.volume("dev_volume"), M.dollar_bad_rate("dev_rate", "loss", "balance")],
        _SOURCES_WHERE, _source_key(),
    )
    test = summarize(
        only_sources(rows, ["test"]), ["key"], [M.volume("test_volume")], _SOURCES_WHERE, _source_key()
    )
    return round_columns(join_summaries([dev, test], ["key"]), 4, "dev_rate")


@query(
    f"""
    WITH {LOANS}
    SELECT count(*) FILTER (source = 'dev') AS dev_volume, count(*) FILTER (source = 'test') AS test_volume,
      quantile_cont(l_quantity, 0.5) FILTER (source = 'test') AS test_median
    FROM loans
    """
)
def overall_summary_over_sources(spark, sf_dir):
    return summarize(
        portfolio(spark, sf_dir),
        [],
        [
            M.volume("dev_volume").on("dev"),
            M.volume("test_volume").on("test"),
            M.median("test_median", "l_quantity").on("test"),
        ],
    )


@query(
    f"""
    WITH {LOANS}, g(key, i) AS (VALUES (3, 0), (1, 1), (9, 2), (7, 3), (2, 4))
    SELECT g.key, count(*) AS volume, round(sum(loss) / sum(balance) * 100, 4) AS rate,
      round(stddev_samp(l_quantity), 6) AS std_q, quantile_cont(l_extendedprice, 0.5) AS median_price,
      max(l_tax) AS top_tax
    FROM g JOIN g AS h ON h.i <= g.i JOIN loans ON l_linenumber = h.key
    GROUP BY g.key
    """
)
def cumulative_metrics(spark, sf_dir):
    """Groups in a given order, one of them without rows."""
    found = cumulative(
        loans(spark, sf_dir),
        "l_linenumber",
        [3, 1, 9, 7, 2],
        [
            M.volume("volume"),
            M.dollar_bad_rate("rate", "loss", "balance"),
            M.std("std_q", "l_quantity"),
            M.median("median_price", "l_extendedprice"),
            M.largest("top_tax", "l_tax"),
        ],
    ).withColumnRenamed("l_linenumber", "key")
    return round_columns(round_columns(found, 4, "rate"), 6, "std_q")


@query(
    f"""
    WITH {LOANS}, g(tier, i) AS (VALUES ('N', 0), ('R', 1), ('A', 2))
    SELECT g.tier, count(*) FILTER (source = 'dev') AS dev_volume,
      round(sum(balance) FILTER (source = 'test'), 2) AS test_balance
    FROM g JOIN g AS h ON h.i <= g.i JOIN loans ON l_returnflag = h.tier
    GROUP BY g.tier
    """
)
def cumulative_over_sources(spark, sf_dir):
    found = cumulative(
        portfolio(spark, sf_dir),
        "tier",
        ["N", "R", "A"],
        [M.volume("dev_volume").on("dev"), M.total("test_balance", "balance").on("test")],
        with_columns={"tier": F.col("l_returnflag")},
    )
    return round_columns(found, 2, "test_balance")


@query(
    f"""
    WITH {LOANS}, g(key, i) AS (VALUES (3, 0), (1, 1), (9, 2), (7, 3), (2, 4)),
    upto AS (SELECT g.key, loans.* FROM g JOIN g AS h ON h.i <= g.i JOIN loans ON l_linenumber = h.key),
    ordered AS (
      SELECT key, l_quantity AS q,
        lag(l_quantity) OVER (PARTITION BY key ORDER BY {', '.join(ROW_ORDER)}) AS previous
      FROM upto),
    counted AS (
      SELECT key, l_quantity AS q, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, l_quantity) AS place
      FROM upto GROUP BY 1, 2)
    SELECT upto.key, any_value(mode_q) AS mode_q, any_value(r) AS autocorr_q,
      round(skewness, 6) AS skew_q, round(kurt, 6) AS kurt_q, round(corr_qp, 6) AS corr_qp
    FROM (
      SELECT key, avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5) AS skewness,
        avg(pow(l_quantity - m, 4)) / pow(avg(pow(l_quantity - m, 2)), 2) - 3 AS kurt,
        corr(l_quantity, l_extendedprice) AS corr_qp
      FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY key) AS m FROM upto) GROUP BY key) AS upto
    JOIN (SELECT key, q AS mode_q FROM counted WHERE place = 1) AS c ON c.key = upto.key
    JOIN (SELECT key, round(corr(q, previous), 6) AS r FROM ordered GROUP BY key) AS o ON o.key = upto.key
    GROUP BY ALL
    """
)
def cumulative_order_and_shape(spark, sf_dir):
    """Mode, autocorrelation and moments over running groups: no row is copied."""
    found = cumulative(
        loans(spark, sf_dir),
        "l_linenumber",
        [3, 1, 9, 7, 2],
        [
            M.mode("mode_q", "l_quantity"),
            M.autocorrelation("autocorr_q", "l_quantity", ROW_ORDER),
            M.skewness("skew_q", "l_quantity"),
            M.kurtosis("kurt_q", "l_quantity"),
            M.correlation("corr_qp", "l_quantity", "l_extendedprice"),
        ],
    ).withColumnRenamed("l_linenumber", "key")
    return round_columns(found, 6, "autocorr_q", "skew_q", "kurt_q", "corr_qp")


@query(
    """
    WITH sets AS (
      SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS level,
        round(stddev_samp(l_extendedprice), 4) AS std_p, round(covar_samp(l_quantity, l_extendedprice), 3) AS cov_qp,
        round(sum(l_quantity), 2) AS total_q
      FROM lineitem
      GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())),
    counted AS (
      SELECT l_returnflag, l_linestatus, l_quantity, GROUPING(l_returnflag, l_linestatus) AS level, count(*) AS n
      FROM lineitem
      GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, l_quantity), (l_returnflag, l_quantity),
        (l_linestatus, l_quantity), (l_quantity))),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY level, l_returnflag, l_linestatus ORDER BY n DESC, l_quantity) AS place
      FROM counted)
    SELECT sets.*, best.l_quantity AS mode_q
    FROM sets JOIN best ON best.place = 1 AND best.level = sets.level
      AND best.l_returnflag IS NOT DISTINCT FROM sets.l_returnflag
      AND best.l_linestatus IS NOT DISTINCT FROM sets.l_linestatus
    """
)
def subtotals_that_merge(spark, sf_dir):
    """Moments and modes of all levels from one summary of the finest groups each."""
    dims = ["l_returnflag", "l_linestatus"]
    found = summarize_levels(
        table(spark, sf_dir, "lineitem"),
        dims,
        [dims, dims[:1], dims[1:], []],
        [
            M.std("std_p", "l_extendedprice"),
            M.covariance("cov_qp", "l_quantity", "l_extendedprice"),
            M.total("total_q", "l_quantity"),
            M.mode("mode_q", "l_quantity"),
        ],
    ).withColumnRenamed(LEVEL, "level")
    return round_columns(round_columns(round_columns(found, 4, "std_p"), 3, "cov_qp"), 2, "total_q")


@query(
    """
    SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS level, true AS close,
      count(DISTINCT l_partkey) AS exact_n
    FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())
    """
)
def sketched_counts_per_level(spark, sf_dir):
    """Sketches kept per finest group and united for subtotals, within 8 % of the distinct values."""
    dims = ["l_returnflag", "l_linestatus"]
    rows, levels = table(spark, sf_dir, "lineitem"), [dims, dims[:1], []]
    sketched = summarize_levels(rows, dims, levels, [M.distinct_count("estimate", "l_partkey", approximate=True)])
    exact = summarize_levels(rows, dims, levels, [M.distinct_count("exact_n", "l_partkey")])
    found = null_safe_join(exact, sketched, [*dims, LEVEL], "left")
    close = F.abs(F.col("estimate") - F.col("exact_n")) <= 0.08 * F.col("exact_n")
    return found.select(*dims, F.col(LEVEL).alias("level"), close.alias("close"), "exact_n")
