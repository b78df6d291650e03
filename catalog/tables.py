"""Report tables: segments, cells, pivots, comparisons, reshaping."""

from pyspark.sql import functions as F

from bandwise.operators import metrics as M
from bandwise.operators.summarize import summarize
from bandwise.plans.tables import (
    Scaling,
    cell_grid,
    cell_table,
    compare_chains,
    dimension_candidates,
    formatted,
    pivot_long,
    pivot_wide,
    segment_dimension,
    segment_table,
    to_long,
    to_wide,
)
from catalog.chains import SCORED, SEGMENTS, two_step_chain
from catalog.data import LOANS, loans, portfolio, round_columns, table
from catalog.registry import query


def _metrics():
    return [M.volume("volume"), M.dollar_bad_rate("rate", "loss", "balance")]


_SEGMENTS_SQL = f"""
    WITH {SCORED},
    f AS (SELECT * FROM scored WHERE l_tax < 0.08),
    per AS (SELECT segment, count(*) AS volume, sum(loss) / sum(balance) * 100 AS rate, quantile_cont(l_extendedprice, 0.5) AS mid
            FROM f GROUP BY 1),
    cum AS (SELECT s.id, count(segment) AS running, sum(loss) / sum(balance) * 100 AS running_rate
            FROM segs s LEFT JOIN f ON segment <= s.id GROUP BY 1)
    SELECT s.id AS position, s.id AS segment_id, s.name, volume, round(rate * greatest(maf_d * 1.2, 1), 4) AS rate,
      round(mid, 4) AS mid, running, round(running_rate, 4) AS running_rate
    FROM segs s LEFT JOIN per ON segment = s.id LEFT JOIN cum USING (id)
    UNION ALL
    SELECT 4, NULL, 'Total', count(*), round(sum(loss) / sum(balance) * 100 * 1.2, 4),
      round(quantile_cont(l_extendedprice, 0.5), 4), count(*), round(sum(loss) / sum(balance) * 100, 4) FROM f
    """


def _segment_metrics():
    return [
        *_metrics(),
        M.median("mid", "l_extendedprice"),
        M.volume("running").running(),
        M.dollar_bad_rate("running_rate", "loss", "balance").running(),
    ]


@query(_SEGMENTS_SQL)
def table_of_segments(spark, sf_dir):
    """Plain, order-statistic and cumulative metrics per segment with a total; scaled rate."""
    rows = loans(spark, sf_dir)
    found = segment_table(
        rows, two_step_chain(rows), SEGMENTS, _segment_metrics(), where="l_tax < 0.08",
        scaling=Scaling(dollar={"rate": 1.2}),
    )
    return round_columns(found, 4, "rate", "mid", "running_rate")


@query(
    f"""
    WITH {SCORED}
    SELECT s.name, CASE WHEN count(segment) > 0 THEN format('{{:,}}', count(segment)) END AS volume,
      CASE WHEN count(segment) > 0 THEN printf('%.2f', round(sum(loss) / sum(balance) * 100, 2)) || '%' END AS rate
    FROM segs s LEFT JOIN scored ON segment = s.id GROUP BY ALL
    """
)
def table_of_segments_formatted(spark, sf_dir):
    rows = loans(spark, sf_dir)
    found = segment_table(rows, two_step_chain(rows), SEGMENTS, _metrics(), total=False)
    return formatted(found, _metrics()).select("name", "volume", "rate")


_CELLS_SQL = f"""
    WITH {SCORED},
    agg AS (SELECT band, parent, grouping(band) = 1 AS total_row, grouping(parent) = 1 AS total_column,
              count(*) AS volume, sum(loss) / sum(balance) * 100 AS rate
            FROM scored GROUP BY GROUPING SETS ((band, parent), (band), (parent), ()))
    SELECT band AS band_id, parent AS parent_id, total_row, total_column, volume,
      round(rate * CASE WHEN total_column THEN greatest(1.5, 1)
                        WHEN total_row THEN (SELECT greatest(maf_d * 1.5, 1) FROM segs WHERE id = parent)
                        ELSE (SELECT greatest(maf_d * 1.5, 1) FROM segs WHERE id = least(greatest(parent + band - 1, 0), 3)) END, 4) AS rate
    FROM agg
    """


@query(_CELLS_SQL)
def table_of_cells(spark, sf_dir):
    """Bands by parent segments with totals; cells scaled by their target segment."""
    rows = loans(spark, sf_dir)
    found = cell_table(
        rows, two_step_chain(rows), SEGMENTS, _metrics(), scaling=Scaling(dollar={"rate": 1.5})
    )
    return round_columns(found, 4, "rate")


@query(
    f"""
    WITH {SCORED}
    SELECT grouping(band) = 1 AS total_row, band AS band_id,
      count(*) FILTER (parent = 0) AS low, count(*) FILTER (parent = 1) AS mid, count(*) FILTER (parent = 2) AS high,
      count(*) FILTER (parent = 3) AS top, count(*) AS "Total"
    FROM scored GROUP BY GROUPING SETS ((band), ())
    """
)
def grid_of_cells(spark, sf_dir):
    rows = loans(spark, sf_dir)
    cells = cell_table(rows, two_step_chain(rows), SEGMENTS, _metrics()[:1])
    return cell_grid(cells, "volume", SEGMENTS)


def _pivot_sql(metrics: str) -> str:
    return f"""
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag,
      CASE WHEN grouping(key) = 1 THEN 'Total' ELSE key END AS key,
      CASE WHEN grouping(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END AS l_linestatus, {metrics}
    FROM (SELECT *, CASE WHEN l_linenumber < 4 THEN CAST(l_linenumber AS VARCHAR) END AS key FROM loans WHERE l_quantity > 3)
    GROUP BY GROUPING SETS ((l_returnflag, key, l_linestatus), (l_returnflag, key), (l_returnflag, l_linestatus),
      (l_returnflag), (l_linestatus), ())
    """


def _pivot(spark, sf_dir, metrics):
    key = F.when(F.col("l_linenumber") < 4, F.col("l_linenumber"))
    found = pivot_long(
        loans(spark, sf_dir), ["l_returnflag", "key"], ["l_linestatus"], metrics,
        where="l_quantity > 3", with_columns={"key": key},
    )
    return found.drop("__level__")


@query(f"WITH {LOANS} " + _pivot_sql("count(*) AS volume, round(sum(loss) / sum(balance) * 100, 4) AS rate"))
def pivot_with_subtotals(spark, sf_dir):
    """Two row dimensions, one across; a null key is a group of its own."""
    return round_columns(_pivot(spark, sf_dir, _metrics()), 4, "rate")


@query(
    f"WITH {LOANS} "
    + _pivot_sql(
        """quantile_cont(l_quantity, 0.5) AS median_q, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers,
        round(stddev_samp(l_tax), 6) AS std_tax"""
    )
)
def pivot_of_other_aggregates(spark, sf_dir):
    """Order statistics, distinct counts and deviations at every level."""
    metrics = [
        M.median("median_q", "l_quantity"),
        M.distinct_count("suppliers", "l_suppkey"),
        M.std("std_tax", "l_tax"),
    ]
    return round_columns(_pivot(spark, sf_dir, metrics), 6, "std_tax")


@query(
    """
    SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Total' ELSE l_returnflag END AS l_returnflag,
      count(*) FILTER (l_linestatus = 'F') AS "F", count(*) FILTER (l_linestatus = 'O') AS "O", count(*) AS "Total"
    FROM lineitem GROUP BY ROLLUP (l_returnflag)
    """
)
def pivot_laid_out_wide(spark, sf_dir):
    long = pivot_long(table(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_linestatus"], _metrics()[:1])
    return pivot_wide(long, ["l_returnflag"], ["l_linestatus"], "volume")


def _lookalikes_sql() -> str:
    """One counted column per header: a value, its text in the header."""
    keys = [("key = 'Total'", '"Total"'), ("key = 'null'", '"null"'), ("key = 'a | b'", '"a | b"'), ("key IS NULL", "null")]
    states = [("l_linestatus = 'F'", "F"), ("l_linestatus = 'O'", "O"), ("true", "Total")]
    cells = [(f"{k} AND {s}", f"{a} | {b}") for k, a in keys for s, b in states] + [("true", "Total | Total")]
    columns = ", ".join(
        "nullif(count(*) FILTER ({}), 0) AS \"{}\"".format(test, name.replace('"', '""')) for test, name in cells
    )
    return f"""
    SELECT CASE WHEN grouping(flag) = 1 THEN 'Total' ELSE flag END AS flag, grouping(flag) AS level, {columns}
    FROM (SELECT *, CASE l_returnflag WHEN 'R' THEN 'Total' WHEN 'A' THEN 'null' END AS flag,
            CASE WHEN l_linenumber = 1 THEN 'Total' WHEN l_linenumber = 2 THEN 'null' WHEN l_linenumber = 3 THEN 'a | b' END AS key
          FROM lineitem)
    GROUP BY ROLLUP (flag)
    """


@query(_lookalikes_sql())
def pivot_wide_with_lookalikes(spark, sf_dir):
    """Two dimensions across; the data hold ``Total``, ``null``, missing values and the separator."""
    flag = F.when(F.col("l_returnflag") == "R", "Total").when(F.col("l_returnflag") == "A", "null")
    number = F.col("l_linenumber")
    key = F.when(number == 1, "Total").when(number == 2, "null").when(number == 3, "a | b")
    rows = table(spark, sf_dir, "lineitem").withColumns({"flag": flag, "key": key})
    long = pivot_long(rows, ["flag"], ["key", "l_linestatus"], _metrics()[:1])
    return pivot_wide(long, ["flag"], ["key", "l_linestatus"], "volume", row_level="level")


@query(
    f"""
    WITH {SCORED}
    SELECT CASE WHEN grouping(name) = 1 THEN 'Total' ELSE name END AS segment,
      CASE WHEN grouping(l_linestatus) = 1 THEN 'Total' ELSE l_linestatus END AS l_linestatus, count(*) AS volume
    FROM scored LEFT JOIN segs ON id = segment GROUP BY GROUPING SETS ((name, l_linestatus), (name), (l_linestatus), ())
    """
)
def pivot_by_segment_name(spark, sf_dir):
    rows = loans(spark, sf_dir)
    named = segment_dimension(rows, two_step_chain(rows), SEGMENTS, "segment")
    return pivot_long(named, ["segment"], ["l_linestatus"], _metrics()[:1]).drop("__level__")


@query(
    """
    SELECT * FROM (
      SELECT 'l_returnflag' AS variable, count(DISTINCT l_returnflag) AS n_unique FROM lineitem
      UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber) FROM lineitem
      UNION ALL SELECT 'tax', count(DISTINCT l_tax) FROM lineitem
      UNION ALL SELECT 'l_discount', count(DISTINCT l_discount) FROM lineitem
      UNION ALL SELECT 'l_orderkey', count(DISTINCT l_orderkey) FROM lineitem) WHERE n_unique <= 10
    """
)
def columns_fit_for_pivots(spark, sf_dir):
    """``tax`` is null where it is zero: null counts as a value."""
    rows = table(spark, sf_dir, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return dimension_candidates(rows, ["l_returnflag", "l_linenumber", "tax", "l_discount", "l_orderkey"])


@query(
    f"""
    WITH {SCORED}, long AS (SELECT 'one step' AS chain, parent AS seg, loss, balance FROM scored
      UNION ALL SELECT 'two steps', segment, loss, balance FROM scored)
    SELECT c.chain, s.id AS position, s.id AS segment_id, s.name, count(seg) AS volume,
      round(sum(loss) / sum(balance) * 100, 4) AS rate
    FROM (VALUES ('one step'), ('two steps')) c(chain) CROSS JOIN segs s LEFT JOIN long ON long.chain = c.chain AND seg = s.id
    GROUP BY ALL
    """
)
def chains_side_by_side(spark, sf_dir):
    rows = loans(spark, sf_dir)
    two = two_step_chain(rows)
    found = compare_chains(
        rows, {"one step": (two[:1], SEGMENTS), "two steps": (two, SEGMENTS)}, _metrics()
    )
    return round_columns(found, 4, "rate")


@query(
    f"""
    WITH {SCORED}, f AS (SELECT * FROM scored WHERE l_tax < 0.08),
    long AS (SELECT 'one step' AS chain, parent AS seg, loss, balance FROM f
      UNION ALL SELECT 'two steps', segment, loss, balance FROM f),
    places AS (SELECT * FROM (VALUES ('one step'), ('two steps')) c(chain) CROSS JOIN segs),
    own AS (SELECT p.chain, id, count(seg) AS volume, sum(loss) / sum(balance) * 100 AS rate
            FROM places p LEFT JOIN long l ON l.chain = p.chain AND seg = id GROUP BY ALL),
    upto AS (SELECT p.chain, id, count(seg) AS running, sum(loss) / sum(balance) * 100 AS running_rate
             FROM places p LEFT JOIN long l ON l.chain = p.chain AND seg <= id GROUP BY ALL)
    SELECT chain, id AS position, id AS segment_id, name, volume, round(rate * greatest(maf_d * 1.2, 1), 4) AS rate,
      running, round(running_rate * greatest(maf_d * 1.5, 1), 4) AS running_rate
    FROM places JOIN own USING (chain, id) JOIN upto USING (chain, id)
    UNION ALL
    SELECT chain, 4, NULL, 'Total', count(*), round(sum(loss) / sum(balance) * 100 * 1.2, 4), count(*),
      round(sum(loss) / sum(balance) * 100 * 1.5, 4) FROM long GROUP BY chain
    """
)
def chains_compared_in_full(spark, sf_dir):
    """Own and cumulative metrics per segment of two chains, scaled, with totals."""
    rows = loans(spark, sf_dir)
    two = two_step_chain(rows)
    metrics = [
        *_metrics(),
        M.volume("running").running(),
        M.dollar_bad_rate("running_rate", "loss", "balance").running(),
    ]
    found = compare_chains(
        rows, {"one step": (two[:1], SEGMENTS), "two steps": (two, SEGMENTS)}, metrics,
        where="l_tax < 0.08", total=True, scaling=Scaling(dollar={"rate": 1.2, "running_rate": 1.5}),
    )
    return round_columns(found, 4, "rate", "running_rate")


@query(
    """
    SELECT l_returnflag, count(*) FILTER (l_linenumber = 2) AS "2", count(*) FILTER (l_linenumber = 1) AS "1",
      CAST(NULL AS BIGINT) AS "9"
    FROM lineitem GROUP BY 1
    """
)
def long_to_wide(spark, sf_dir):
    """Columns in the given order, one of them without data."""
    long = summarize(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], [M.volume("n")])
    return to_wide(long, ["l_returnflag"], "l_linenumber", "n", [2, 1, 9])


@query(
    """
    SELECT l_returnflag, m AS metric, CASE m WHEN 'items' THEN n ELSE q END AS value
    FROM (SELECT l_returnflag, CAST(count(*) AS DOUBLE) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
      (VALUES ('items'), ('quantity')) AS v(m)
    """
)
def wide_to_long(spark, sf_dir):
    wide = summarize(
        table(spark, sf_dir, "lineitem"), ["l_returnflag"],
        [M.total("items", F.lit(1.0)), M.total("quantity", "l_quantity")],
    )
    return to_long(wide, ["l_returnflag"], "metric", "value")


@query(
    f"""
    WITH {SCORED}
    SELECT s.id AS position, s.id AS segment_id, s.name, CASE WHEN count(*) FILTER (source = 'dev') > 0
        THEN count(*) FILTER (source = 'dev') END AS dev_volume,
      CASE WHEN count(*) FILTER (source = 'test') > 0 THEN round(avg(bad) FILTER (source = 'test') * 100, 4) END AS test_rate
    FROM segs s LEFT JOIN scored ON segment = s.id GROUP BY ALL
    UNION ALL SELECT 4, NULL, 'Total', count(*) FILTER (source = 'dev'), round(avg(bad) FILTER (source = 'test') * 100, 4) FROM scored
    """
)
def table_of_segments_over_sources(spark, sf_dir):
    """Development volume beside the early delinquency of the test source."""
    rows = portfolio(spark, sf_dir)
    metrics = [M.volume("dev_volume").on("dev"), M.unit_bad_rate("test_rate", "bad").on("test")]
    found = segment_table(rows, two_step_chain(rows), SEGMENTS, metrics)
    return round_columns(found, 4, "test_rate")

