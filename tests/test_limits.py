"""Results that must not depend on limits, and text that must not depend on where it is made."""

import math

import pytest
from pyspark.sql import functions as F

from bandwise.functions.labels import format_value, quantile_label
from bandwise.operators.bands import Band, clip_outer_bounds
from bandwise.operators.information_value import iv_ranking
from bandwise.operators.loss_bands import value_step
from bandwise.operators.ordering import RANGE, Sketch, ranged_rows, with_buckets
from bandwise.operators.profile import quantile_table
from bandwise.operators.quantiles import Ask, column_quantiles, level_quantiles, selected_quantiles
from bandwise.plans.chain import Step, score, scoring_sql

INF = math.inf


@pytest.mark.parametrize("limit", [1, 10_000])
@pytest.mark.parametrize("values, fraction, expected", [([-INF, 1.0, 2.0, 3.0], 0.1, -INF), ([1.0, 2.0, INF], 0.75, INF), ([1.0, 2.0, INF], 0.5, 2.0)])
def test_quantiles_of_infinities(spark, limit, values, fraction, expected):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert column_quantiles(df, ["x"], [fraction], limit)["x"] == [expected]


def test_rows_of_few_ordering_tuples_are_spread(spark):
    df = spark.range(40_000).select((F.col("id") % 200).alias("day"))
    sizes = [r["count"] for r in ranged_rows(df, ["day"], limit=10).groupBy(RANGE).count().collect()]
    assert len(sizes) == 200 and max(sizes) == 200
    assert ranged_rows(df, ["day"]).select(RANGE).distinct().count() == 1


def test_quantile_table_keeps_every_column(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(5.0,)], "x double")
    table = quantile_table(df, "x", [0.125, 0.991, 0.994])
    assert table.columns == ["variable", "12th Percentile", "99th Percentile", "99th Percentile"]
    assert all(v is not None for v in table.first())
    nothing = spark.createDataFrame([(None,)], "x double")
    assert len(quantile_table(nothing, "x", [0.1, 0.2]).columns) == 3


def test_one_rounding_rule(spark):
    row = spark.range(1).select(
        format_value(F.lit(0.125)).alias("a"), format_value(F.lit(0.125), thousands=False).alias("b"),
        format_value(F.lit(12345.678), thousands=False).alias("c"), quantile_label(F.lit(0.125)).alias("d"),
    ).first()
    assert tuple(row) == ("0.12", "0.12", "12345.68", "12th Percentile")


def test_wide_text_variables_can_be_ranked(spark):
    df = spark.createDataFrame([(f"v{i % 12}", i % 2) for i in range(120)] + [("v0", 1)], "t string, y int")
    # Near the limit the number of values is exact.
    assert tuple(iv_ranking(df, "y", ["t"]).first()) == ("t", None, None, 12, "more than 10 values")
    ranked = iv_ranking(df, "y", ["t"], max_text_values=None).first()
    assert ranked["variable"] == "t" and ranked["iv"] >= 0 and ranked["reason"] is None


def test_skipped_variables_come_out_as_rows(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("wide"), (F.col("id") % 2).alias("y"), F.col("id").alias("n"))
    n, wide = iv_ranking(df, "y", ["wide", "n"]).collect()
    assert (n["variable"], n["n_values"], n["reason"]) == ("n", None, None)
    assert (wide["iv"], wide["strength"], wide["reason"]) == (None, None, "more than 10 values")
    assert wide["n_values"] == pytest.approx(3000, rel=0.2)
    assert iv_ranking(df, "y", ["wide"]).count() == 1


@pytest.mark.parametrize("gap, step", [(None, 1), (0, 1), (INF, 1), (250, 100), (1, 1), (1.5, 1), (0.25, 0.01), (0.5, 0.1), (1e-7, 1e-7), (12345.5, 10000)])
def test_value_step(gap, step):
    assert value_step(gap) == step


def test_clipped_bounds_keep_order_and_ties():
    bands = [Band(1, 5.0, INF), Band(0, -INF, 5.0)]
    assert clip_outer_bounds(bands, 1.0, 9.0) == [Band(1, 5.0, 9.0), Band(0, 1.0, 5.0)]
    assert clip_outer_bounds([Band(0, 0.5, 2.0)], 1.0, 9.0) == [Band(0, 0.5, 9.0)]
    assert clip_outer_bounds([Band(0, 0.5, 2.0)], 1.0, 9.0, include_min=False) == [Band(0, 1.0, 9.0)]


def test_scoring_text_runs_elsewhere(spark):
    import duckdb

    rows = [(v, c) for v in (1.0, 4.0, 8.0, None) for c in ("it's", "a\\b", 'say "x"', None)]
    df = spark.createDataFrame(rows, "x double, c string")
    root = Step("x", (Band(0, -INF, 3.0), Band(1, 3.0, INF)))
    words = (Band(0, categories=frozenset(["it's", "a\\b"])), Band(1, categories=frozenset(['say "x"', "a\\b"])))
    child = Step("c", words, grid={(0, 0): 1, (0, 1): 0, (1, 1): 1})
    chain = [root, child]
    expected = sorted(map(repr, map(tuple, score(df, chain).select("x", "c", "segment").collect())))
    df.createOrReplaceTempView("scored_here")
    own = spark.sql(scoring_sql(chain, "scored_here")).select("x", "c", "segment")
    assert sorted(map(repr, map(tuple, own.collect()))) == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x DOUBLE, c VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    found = con.execute(f'SELECT x, c, segment FROM ({scoring_sql(chain, "t", quote=chr(34))})').fetchall()
    assert sorted(map(repr, found)) == expected


def _exchanges_by_value(plan: str) -> list[tuple[str, str]]:
    """Each exchange keyed by a value, with the part of the plan below it."""
    lines = plan.split("\n")
    found = []
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line and "value#" in line.split("ENSURE")[0]:
            depth = len(line) - len(line.lstrip(" :+-|"))
            below = []
            for later in lines[i + 1 :]:
                if len(later) - len(later.lstrip(" :+-|")) <= depth:
                    break
                below.append(later)
            found.append((line, "\n".join(below)))
    return found


def test_only_values_in_wanted_ranges_are_shuffled(spark):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    edges = [[i / 512 for i in range(1, 512)]] * 2
    asks = [Ask(0.5), Ask(0.9, "nearest")]
    found = selected_quantiles(rows, ["k"], [F.col("x"), F.col("y")], asks, edges, {0: ["k"], 1: []})
    plan = found._jdf.queryExecution().executedPlan().toString()
    by_value = _exchanges_by_value(plan)
    assert by_value
    for _, below in by_value:
        assert "BroadcastHashJoin" in below and "LeftSemi" in below


def test_selection_agrees_with_maps_for_groups_levels_and_odd_values(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1e300, *[i * 0.37 for i in range(200)], *[7.5] * 90]
    rows = spark.createDataFrame(
        [(g, v, i) for g in ("a", "b", None) for i, v in enumerate(values) if g != "b" or i % 3], "g string, x double, y long"
    )
    asks = [Ask(q) for q in (0.0, 0.1, 0.5, 0.77, 1.0)]
    levels = {0: ["g"], 1: []}
    variables = [F.col("x"), F.col("y")]
    plain = [Sketch(1, [])] * 2
    expected = level_quantiles(rows, ["g"], variables, asks, plain, levels=levels)
    for edges in ([], [7.5], [i * 0.37 for i in range(100)], sorted(i * 0.371 for i in range(511))):
        got = selected_quantiles(rows, ["g"], variables, asks, [edges, edges], levels)
        key = lambda r: (r["__level__"], r["g"] or "", r["variable"])
        for a, b in zip(sorted(got.collect(), key=key), sorted(expected.collect(), key=key), strict=True):
            assert key(a) == key(b) and repr(a["quantiles"]) == repr(b["quantiles"])


def test_buckets_of_all_values_by_search(spark):
    values = [None, float("nan"), float("inf"), float("-inf"), *[i / 7 for i in range(-20, 700)]]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for count in (0, 5, 30, 64, 200, 511):
        edges = [i * 100 / (count + 1) for i in range(count)]
        got = with_buckets(rows, {"x": edges}, {"x": "r"}).filter("x is not null").collect()
        for x, r in got:
            assert r == (count if x != x else sum(e < x for e in edges)), (count, x)
