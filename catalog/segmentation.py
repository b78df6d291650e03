"""Bands, loss-rate banding, segments and scoring."""

from pyspark.sql import functions as F

from bandwise.operators.bands import (
    Band,
    assign_categories,
    assign_lookup,
    assign_numeric,
    bands_frame,
    category_count,
    check_category_bands,
    check_numeric_bands,
    clip_outer_bounds,
    collect_categories,
    describe_bands,
    even_category_bands,
    numeric_range,
    quantile_bands,
)
from bandwise.operators.loss_bands import (
    LossRate,
    loss_rate_bands,
    loss_rate_categories,
    rate_table,
    risk_direction,
    value_step,
)
from bandwise.operators.quantiles import min_gap
from bandwise.operators.segments import (
    DOLLAR,
    Segment,
    collect_segments,
    contiguous_lower_rates,
    scale_factor_table,
    scale_rates,
    segment_by_rate,
    split_equal_rates,
)
from bandwise.plans.chain import score, scoring_sql
from catalog.chains import SCORED, SEGMENTS, two_step_chain
from catalog.data import LOANS, accounts, loans, round_columns, rounded, table
from catalog.registry import query

INF = float("inf")


def _finite(df, *names):
    """Unbounded limits as null."""
    return df.withColumns(
        {n: F.when(F.abs(F.col(n)) < INF, F.col(n)) for n in names}
    )


@query(
    """
    SELECT CASE WHEN l_quantity > 1 AND l_quantity <= 10 THEN 1 WHEN l_quantity > 10 AND l_quantity <= 20 THEN 2
                WHEN l_quantity > 30 THEN 3 END AS band, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
    FROM lineitem GROUP BY 1
    """
)
def numeric_bands_assigned(spark, sf_dir):
    """Open on the left, closed on the right; rows in a gap or at the lowest bound have none."""
    bands = [Band(1, 1, 10), Band(2, 10, 20), Band(3, 30, None)]
    band = assign_numeric(F.col("l_quantity"), bands)
    return table(spark, sf_dir, "lineitem").groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high")
    )


_FORTY = ", ".join(f"{i}/40.0" for i in range(1, 40))


@query(
    f"""
    SELECT CAST(len(list_filter(e, lambda q: q < l_extendedprice)) AS INT) AS band, count(*) AS n,
      min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem, (SELECT quantile_cont(l_extendedprice, [{_FORTY}]) AS e FROM lineitem) GROUP BY 1
    """
)
def many_numeric_bands_assigned(spark, sf_dir):
    """Forty bands: found by binary search."""
    rows = table(spark, sf_dir, "lineitem")
    band = assign_numeric(F.col("l_extendedprice"), quantile_bands(rows, "l_extendedprice", 40))
    return rows.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("l_extendedprice").alias("low"),
        F.max("l_extendedprice").alias("high"),
    )


@query(
    """
    SELECT CASE WHEN o_orderpriority < '3' THEN 0 WHEN o_orderpriority < '5' THEN 1 ELSE 2 END AS band,
      count(*) AS n FROM orders GROUP BY 1
    """
)
def category_bands_assigned(spark, sf_dir):
    """Five priorities in three bands of two, two and one."""
    orders = table(spark, sf_dir, "orders")
    bands = collect_categories(even_category_bands(orders, "o_orderpriority", 3))
    band = assign_categories(F.col("o_orderpriority"), bands)
    return orders.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


_BRANDS = """
    WITH d AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS c FROM lineitem),
    r AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS k, count(*) OVER () AS n FROM d),
    b AS (SELECT c, CAST(CASE WHEN k < (n % 7) * (n // 7 + 1) THEN k // (n // 7 + 1)
            ELSE n % 7 + (k - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INT) AS band FROM r)
    """


@query(
    _BRANDS
    + """SELECT band, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM lineitem JOIN b ON CAST(l_partkey AS VARCHAR) = c GROUP BY 1"""
)
def category_bands_joined(spark, sf_dir):
    """Part keys as categories: too many for an expression, so the table is joined."""
    rows = table(spark, sf_dir, "lineitem")
    keyed = rows.withColumn("part", F.col("l_partkey").cast("string"))
    lookup = even_category_bands(keyed, "part", 7)
    return assign_lookup(keyed, "part", lookup, "band").groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("l_extendedprice"), 2).alias("price")
    )


@query(_BRANDS + "SELECT band AS band_id, count(*) AS n, min(c) AS first, max(c) AS last FROM b GROUP BY 1")
def even_category_bands_in_ranges(spark, sf_dir):
    """Text ranked in parallel ranges."""
    keyed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("part"))
    return even_category_bands(keyed, "part", 7, limit=200).groupBy("band_id").agg(
        F.count("category").alias("n"), F.min("category").alias("first"), F.max("category").alias("last")
    )


@query(
    """
    SELECT * FROM (VALUES (0, 'F'), (1, 'O'), (2, 'P'), (3, NULL)) AS v(band_id, category)
    WHERE category IS NULL OR category IN (SELECT o_orderstatus FROM orders)
    """
)
def even_category_bands_with_empty_chunk(spark, sf_dir):
    """Three statuses in four bands: the last is empty."""
    return even_category_bands(table(spark, sf_dir, "orders"), "o_orderstatus", 4)


@query(
    f"""
    WITH {LOANS}, r AS (SELECT l_suppkey, sum(loss) / sum(balance) AS rate FROM loans GROUP BY 1)
    SELECT CASE WHEN rate >= 0.0 AND rate < 0.016 THEN 'A' WHEN rate >= 0.016 AND rate < 0.0165 THEN 'B'
                WHEN rate >= 0.017 THEN 'C' END AS segment, count(*) AS n FROM r GROUP BY 1
    """
)
def segments_by_rate(spark, sf_dir):
    """Closed on the left, open on the right; a gap has no segment."""
    segments = [
        Segment(0, "A", 0.0, 0.016), Segment(1, "B", 0.016, 0.0165), Segment(2, "C", 0.017, INF)
    ]
    rates = loans(spark, sf_dir).groupBy("l_suppkey").agg(
        (F.sum("loss") / F.sum("balance")).alias("rate")
    )
    return rates.groupBy(segment_by_rate(F.col("rate"), segments).alias("segment")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """
    SELECT band_id,
      round(CASE band_id WHEN 0 THEN NULL WHEN 1 THEN q[1] WHEN 2 THEN q[2] WHEN 3 THEN q[3] ELSE q[4] END, 4) AS lower,
      round(CASE band_id WHEN 0 THEN q[1] WHEN 1 THEN q[2] WHEN 2 THEN q[3] WHEN 3 THEN q[4] END, 4) AS upper
    FROM (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS q FROM orders),
      (VALUES (0), (1), (2), (3), (4)) AS b(band_id)
    """
)
def quantile_band_table(spark, sf_dir):
    bands = quantile_bands(table(spark, sf_dir, "orders"), "o_totalprice", 5)
    return round_columns(_finite(bands_frame(spark, bands), "lower", "upper"), 4, "lower", "upper")


@query(
    f"""
    WITH {LOANS}
    SELECT discount_pct AS value, round(sum(loss), 4) AS numerator, round(sum(balance), 2) AS denominator,
      count(*) AS units
    FROM loans GROUP BY 1
    """
)
def loss_rates_per_value(spark, sf_dir):
    rows = loans(spark, sf_dir)
    dollars = rate_table(rows, "discount_pct", "loss", "balance")
    units = rate_table(rows, "discount_pct", "bad").select("value", F.col("denominator").alias("units"))
    found = dollars.join(units, "value")
    return round_columns(round_columns(found, 4, "numerator"), 2, "denominator")


@query(
    f"""
    WITH {LOANS}, v AS (SELECT 'discount' AS variable, discount_pct AS x, loss, balance FROM loans
      UNION ALL SELECT 'retained', 100 - discount_pct, loss, balance FROM loans),
    r AS (SELECT variable, x::DOUBLE AS x, sum(loss) / sum(balance) AS r FROM v GROUP BY 1, 2),
    m AS (SELECT variable, sum(x * r) / sum(r) AS m1, sum(x * x * r) / sum(r) AS m2, sum(x * x * x * r) / sum(r) AS m3
          FROM r GROUP BY 1)
    SELECT variable, m3 - 3 * m2 * m1 + 2 * m1 * m1 * m1 < 0 AS high_is_risky FROM m
    """
)
def direction_of_risk(spark, sf_dir):
    """Loss grows with the discount, so it falls with what is retained."""
    rows = loans(spark, sf_dir).withColumn("retained", 100 - F.col("discount_pct"))
    found = [
        (name, risk_direction(rate_table(rows, column, "loss", "balance")))
        for name, column in (("discount", "discount_pct"), ("retained", "retained"))
    ]
    return spark.createDataFrame(found, "variable string, high_is_risky boolean")


@query(
    """
    WITH v AS (SELECT 'quantity' AS variable, l_quantity AS x FROM lineitem
      UNION SELECT 'discount', round(l_discount * 100) * 25 FROM lineitem
      UNION SELECT 'nothing', NULL),
    g AS (SELECT variable, x - lag(x) OVER (PARTITION BY variable ORDER BY x) AS gap
          FROM (SELECT DISTINCT * FROM v))
    SELECT variable, min(gap) AS gap,
      CASE WHEN min(gap) IS NULL THEN 1.0::DOUBLE ELSE power(10, floor(log10(min(gap)))) END AS step
    FROM g GROUP BY 1
    """
)
def smallest_gap_and_step(spark, sf_dir):
    rows = loans(spark, sf_dir).select(
        F.col("l_quantity").alias("quantity"),
        (F.col("discount_pct") * 25).alias("discount"),
        F.lit(None).cast("double").alias("nothing"),
    )
    gaps = {name: min_gap(rows, name) for name in rows.columns}
    return spark.createDataFrame(
        [(name, gap, value_step(gap)) for name, gap in gaps.items()],
        "variable string, gap double, step double",
    )


def loss_band_sql(value: str, numerator: str, denominator: str, limits: list[float], ascending: bool) -> str:
    """Greedy banding as a running maximum of the first segment that takes each value."""
    sign = "" if ascending else "-"
    rows = ", ".join(f"({k}, {'1e308' if t == INF else t}::DOUBLE)" for k, t in enumerate(limits))
    last = len(limits) - 1
    bounds = "lo AS lower, hi AS upper" if ascending else "-hi - 1 AS lower, -lo - 1 AS upper"
    return f"""
    WITH {LOANS}, lim(k, t) AS (VALUES {rows}),
    rates AS (SELECT {sign}CAST({value} AS DOUBLE) AS v, sum({numerator}) / {denominator} AS r FROM loans GROUP BY 1),
    took AS (SELECT v, coalesce((SELECT min(k) FROM lim WHERE r < t), 99) AS k FROM rates),
    walk AS (SELECT v, max(k) OVER (ORDER BY v) AS s FROM took),
    ends AS (SELECT k, coalesce((SELECT max(v) FROM walk WHERE s <= k), (SELECT min(v) - 1 FROM rates)) AS e FROM lim),
    b AS (SELECT k, coalesce(lag(e) OVER (ORDER BY k), (SELECT min(v) - 1 FROM rates)) AS lo,
            CASE WHEN k = {last} THEN (SELECT max(v) FROM rates) ELSE e END AS hi FROM ends)
    SELECT k AS band_id, {bounds} FROM b
    """


_LOSS = LossRate("loss", "balance", use_scalar=False)


@query(loss_band_sql("discount_pct", "loss", "sum(balance)", [0.01, 0.02, 0.03, INF], True))
def loss_rate_bands_rising(spark, sf_dir):
    bands = loss_rate_bands(loans(spark, sf_dir), "discount_pct", SEGMENTS, _LOSS, high_is_risky=True)
    return bands_frame(spark, bands)


@query(loss_band_sql("(100 - discount_pct)", "loss", "sum(balance)", [0.01, 0.02, 0.03, INF], False))
def loss_rate_bands_falling(spark, sf_dir):
    """Direction found from the data."""
    rows = loans(spark, sf_dir).withColumn("retained", 100 - F.col("discount_pct"))
    return bands_frame(spark, loss_rate_bands(rows, "retained", SEGMENTS, _LOSS))


_UNIT_SEGMENTS = [
    Segment(0, "a", 0.0, 0.3451, 1.0, 1.0), Segment(1, "b", 0.0, 0.3553, 1.0, 1.0),
    Segment(2, "c", 0.0, 0.4003, 1.0, 1.1), Segment(3, "d", 0.0, 0.4407, 1.0, 1.2),
]


@query(
    loss_band_sql(
        "l_quantity", "bad", "count(*)",
        [0.3451, 0.3553, 0.4003 / 1.1, 0.4407 / 1.2], True,
    )
)
def loss_rate_bands_scaled_units(spark, sf_dir):
    """Rates per row, annualised from 8 months, limits divided by the scale factors."""
    loss = LossRate("bad", mob=8, scalar=1.5)
    segments = [
        Segment(s.id, s.name, s.lower_rate, s.upper_rate * 1.5 * 1.5, s.maf_dollar, s.maf_unit)
        for s in _UNIT_SEGMENTS
    ]
    found = loss_rate_bands(loans(spark, sf_dir), "l_quantity", segments, loss, high_is_risky=True)
    return bands_frame(spark, found)


@query(
    f"""
    WITH {LOANS}, r AS (SELECT CAST(discount_pct AS VARCHAR) AS category, sum(loss) / sum(balance) AS rate
      FROM loans GROUP BY 1)
    SELECT category, CASE WHEN rate * 1.3 * 0.8 < 0.01 THEN 0 WHEN rate * 1.1 * 0.8 < 0.02 THEN 1
      WHEN rate * 0.9 * 0.8 < 0.03 THEN 2 ELSE 3 END AS band_id FROM r
    """
)
def loss_rate_bands_of_categories(spark, sf_dir):
    rows = loans(spark, sf_dir).withColumn("text", F.col("discount_pct").cast("string"))
    return loss_rate_categories(rows, "text", SEGMENTS, LossRate("loss", "balance", scalar=0.8))


@query(
    """
    SELECT 'with minimum' AS variant, 0 AS band_id, min(l_quantity) - 1 AS lower, 10.0::DOUBLE AS upper FROM lineitem
    UNION ALL SELECT 'with minimum', 1, 10.0, max(l_quantity) FROM lineitem
    UNION ALL SELECT 'without', 0, min(l_quantity), 10.0 FROM lineitem
    UNION ALL SELECT 'without', 1, 10.0, max(l_quantity) FROM lineitem
    """
)
def outer_bounds_clipped(spark, sf_dir):
    found = numeric_range(table(spark, sf_dir, "lineitem"), ["l_quantity"]).first()
    low, high = found["minimum"], found["maximum"]
    bands = [Band(0, low - 1, 10), Band(1, 10, INF)]
    variants = [
        bands_frame(spark, clip_outer_bounds(bands, low, high, keep)).withColumn("variant", F.lit(name))
        for name, keep in (("with minimum", True), ("without", False))
    ]
    return variants[0].unionByName(variants[1])


_TAX_SEGMENTS = f"""
    WITH {LOANS}, s AS (SELECT tax_pct AS segment_id, 'T' || tax_pct AS name,
      CASE WHEN tax_pct >= 7 THEN 1e308 ELSE round((tax_pct // 2 + 1) * 0.02, 2) END AS upper_rate
      FROM loans GROUP BY ALL),
    u AS (SELECT upper_rate, coalesce(lag(upper_rate) OVER (ORDER BY upper_rate), 0.0) AS lower_rate
          FROM (SELECT DISTINCT upper_rate FROM s)),
    c AS (SELECT s.*, u.lower_rate FROM s JOIN u USING (upper_rate))
    """


def _tax_segments(spark, sf_dir):
    """A segment table made from the tax rates in the data, several sharing a limit."""
    pct = F.col("tax_pct")
    upper = F.when(pct >= 7, F.lit(INF)).otherwise(F.round((F.floor(pct / 2) + 1) * 0.02, 2))
    return (
        loans(spark, sf_dir).select("tax_pct").distinct()
        .select(
            pct.alias("segment_id"),
            F.concat(F.lit("T"), pct).alias("name"),
            F.lit(0.0).alias("lower_rate"),
            upper.alias("upper_rate"),
            (1.5 - pct * 0.1).alias("maf_dollar"),
            F.lit(1.0).alias("maf_unit"),
        )
    )


@query(
    _TAX_SEGMENTS
    + "SELECT segment_id, name, lower_rate, CASE WHEN upper_rate < 1e300 THEN upper_rate END AS upper_rate FROM c"
)
def contiguous_segment_rates(spark, sf_dir):
    found = contiguous_lower_rates(_tax_segments(spark, sf_dir)).drop("maf_dollar", "maf_unit")
    return _finite(found, "upper_rate")


@query(
    _TAX_SEGMENTS
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY upper_rate ORDER BY segment_id) AS k,
           count(*) OVER (PARTITION BY upper_rate) AS m,
           CASE WHEN upper_rate < 1e300 THEN upper_rate - lower_rate
                ELSE (SELECT max(upper_rate - lower_rate) FROM c WHERE upper_rate < 1e300) END AS span FROM c)
    SELECT segment_id, name, round(lower_rate + span / m * (k - 1), 8) AS lower_rate,
      round(lower_rate + span / m * k, 8) AS upper_rate FROM k"""
)
def equal_segment_rates_split(spark, sf_dir):
    found = split_equal_rates(contiguous_lower_rates(_tax_segments(spark, sf_dir)))
    return round_columns(found.drop("maf_dollar", "maf_unit"), 8, "lower_rate", "upper_rate")


@query(
    f"""
    WITH {LOANS}
    SELECT DISTINCT tax_pct AS segment_id, 'T' || tax_pct AS name, round((1.5 - tax_pct * 0.1) * 100, 6) AS maf_percent,
      round(greatest((1.5 - tax_pct * 0.1) * 1.2, 1), 6) AS scale_factor FROM loans
    """
)
def scale_factors_of_segments(spark, sf_dir):
    found = scale_factor_table(_tax_segments(spark, sf_dir), DOLLAR, 1.2)
    return round_columns(found, 6, "maf_percent", "scale_factor")


@query(
    f"""
    WITH {LOANS}, r AS (SELECT l_linestatus, CASE WHEN tax_pct < 8 THEN tax_pct END AS t,
      sum(loss) / sum(balance) AS rate FROM loans GROUP BY ALL)
    SELECT l_linestatus, t, round(rate * greatest(coalesce(1.5 - t * 0.1, 1.0) * 1.2, 1), 8) AS rate FROM r
    """
)
def rates_scaled_by_segment(spark, sf_dir):
    """Rows without a segment take a maturity factor of 1."""
    rates = (
        loans(spark, sf_dir)
        .groupBy("l_linestatus", F.when(F.col("tax_pct") < 8, F.col("tax_pct")).alias("t"))
        .agg((F.sum("loss") / F.sum("balance")).alias("rate"))
    )
    return round_columns(scale_rates(rates, "rate", "t", _tax_segments(spark, sf_dir), DOLLAR, 1.2), 8, "rate")


@query(
    f"""
    WITH {LOANS}
    SELECT CAST(tax_pct AS INT) AS segment_id, 'T' || tax_pct AS name, count(*) AS n
    FROM loans GROUP BY ALL
    """
)
def segments_from_a_table(spark, sf_dir):
    """A segment table brought to the driver, then used to label rows by rate."""
    segments = collect_segments(
        _tax_segments(spark, sf_dir).withColumns(
            {
                "lower_rate": F.col("segment_id").cast("double"),
                "upper_rate": F.col("segment_id") + F.lit(1.0),
            }
        )
    )
    name = segment_by_rate(F.col("tax_pct").cast("double"), segments)
    return loans(spark, sf_dir).groupBy(F.col("tax_pct").alias("segment_id"), name.alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """
    WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT 'warning' AS severity, 3 AS band_id, 'lower >= upper' AS problem FROM q
    UNION ALL SELECT 'error', 0, 'overlap' FROM q
    UNION ALL SELECT 'warning', NULL, 'upper bounds not monotonic' FROM q
    """
)
def problems_of_numeric_bands(spark, sf_dir):
    """Bands at the quartiles: one reaches too far, one is empty."""
    q1, q2, q3 = (b.upper for b in quantile_bands(table(spark, sf_dir, "lineitem"), "l_quantity", 4)[:3])
    bands = [Band(0, 0, q3), Band(1, q1, q2), Band(2, q3, INF), Band(3, q3, q1)]
    return check_numeric_bands(bands_frame(spark, bands))


@query(
    """
    SELECT 'warning' AS severity, 9 AS band_id, NULL AS category, 'empty band' AS problem
    UNION ALL SELECT DISTINCT 'error', 8, o_orderstatus, 'category in several bands' FROM orders WHERE o_orderstatus = 'O'
    """
)
def problems_of_category_bands(spark, sf_dir):
    bands = even_category_bands(table(spark, sf_dir, "orders"), "o_orderstatus", 3)
    extra = bands.filter("category = 'O'").select(F.lit(8).alias("band_id"), "category")
    empty = bands.agg((F.max("band_id") + 7).alias("band_id"), F.lit(None).cast("string").alias("category"))
    return check_category_bands(bands.unionByName(extra).unionByName(empty))


@query("SELECT count(DISTINCT o_orderpriority) AS categories FROM orders")
def number_of_categories(spark, sf_dir):
    return category_count(table(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    """
    WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
    SELECT 0 AS band_id, '(-Infinity - ' || q[1] || ']' AS band FROM q
    UNION ALL SELECT 1, '(' || q[1] || ' - ' || q[2] || ']' FROM q
    UNION ALL SELECT 2, '(' || q[2] || ' - ' || q[3] || ']' FROM q
    UNION ALL SELECT 3, '(' || q[3] || ' - Infinity]' FROM q
    """
)
def bands_described(spark, sf_dir):
    bands = quantile_bands(table(spark, sf_dir, "lineitem"), "l_quantity", 4)
    return describe_bands(bands_frame(spark, bands))


_SCORED_SUMMARY = f"""
    WITH {SCORED}
    SELECT parent AS segment_1, segment, count(*) AS n, round(sum(balance), 2) AS balance
    FROM scored GROUP BY ALL
    """


def _score_summary(scored):
    return scored.groupBy("segment_1", "segment").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("balance"), 2).alias("balance")
    )


@query(_SCORED_SUMMARY)
def chain_scored(spark, sf_dir):
    rows = loans(spark, sf_dir)
    return _score_summary(score(rows, two_step_chain(rows)))


@query(_SCORED_SUMMARY)
def chain_scored_by_generated_sql(spark, sf_dir):
    rows = loans(spark, sf_dir)
    text = scoring_sql(two_step_chain(rows), "{rows}")
    return _score_summary(spark.sql(text, rows=rows))


@query(
    f"""
    WITH {LOANS}
    SELECT o_orderpriority, round(sum(bad) / count(*), 6) AS rate FROM loans
    JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    """
)
def loss_rates_of_joined_accounts(spark, sf_dir):
    """Rates by an attribute of another table; both sides may be large."""
    rates = rate_table(accounts(spark, sf_dir), "o_orderpriority", "bad")
    return rates.select(
        F.col("value").alias("o_orderpriority"),
        rounded(F.col("numerator") / F.col("denominator"), 6).alias("rate"),
    )
