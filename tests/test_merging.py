"""Metrics whose partial results merge: levels and running groups against plain aggregates and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from bandwise.operators import metrics as M
from bandwise.operators.quantiles import LEVEL, level_modes
from bandwise.operators.summarize import cumulative, summarize, summarize_levels

ROWS = 3000


def central(x="x", y="y"):
    return [
        M.std("std", x), M.variance("var", x), M.skewness("skew", x), M.kurtosis("kurt", x),
        M.standard_error("se", x), M.covariance("cov", x, y), M.correlation("corr", x, y),
    ]


PLAIN = {
    "std": "stddev_samp(x)", "var": "var_samp(x)", "skew": "skewness(x)", "kurt": "kurtosis(x)",
    "se": "stddev_samp(x) / sqrt(count(x))", "cov": "covar_samp(x, y)", "corr": "corr(x, y)",
}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = []
    for i in range(ROWS):
        # Far from zero, groups far from each other, one group of a single row, nulls on either side.
        a, b = rng.choice("pqr"), rng.randrange(4)
        x = None if rng.random() < 0.1 else 1e6 + 1000 * b + rng.gauss(0, 1 + b)
        y = None if rng.random() < 0.1 else rng.expovariate(1.0) + (x or 0) / 1000
        rows.append((i, a, b, x, y, rng.randrange(6), rng.randrange(200)))
    rows.append((ROWS, "solo", 9, 5.0, 1.0, 1, 1))
    return spark.createDataFrame(rows, "i int, a string, b int, x double, y double, v int, day int").repartition(6).persist()


def same(got, expected):
    if expected is None or (isinstance(expected, float) and math.isnan(expected)):
        return got is None or math.isnan(got)
    return got == pytest.approx(expected, rel=1e-8, abs=1e-8)


def test_moments_at_levels_and_running(spark, table):
    levels = [["a", "b"], ["a"], ["b"], []]
    got = summarize_levels(table, ["a", "b"], levels, [*central(), M.volume("n")]).collect()
    for bits, level in zip([0, 1, 2, 3], levels):
        plain = table.groupBy(*level).agg(*(F.expr(e).alias(n) for n, e in PLAIN.items()), F.count("*").alias("n"))
        expected = {tuple(r[k] for k in level): r for r in plain.collect()}
        found = {tuple(r[k] for k in level): r for r in got if r[LEVEL] == bits}
        assert found.keys() == expected.keys()
        for key, row in expected.items():
            for name in [*PLAIN, "n"]:
                assert same(found[key][name], row[name]), (level, key, name, found[key][name], row[name])
    order = [2, 7, 0, 3]
    running = {r.b: r for r in cumulative(table, "b", order, central()).collect()}
    for i, b in enumerate(order):
        row = table.filter(F.col("b").isin(order[: i + 1])).agg(*(F.expr(e).alias(n) for n, e in PLAIN.items())).first()
        assert all(same(running[b][name], row[name]) for name in PLAIN)


def test_constants_have_no_spread(spark):
    df = spark.createDataFrame([(g, 0.1, float(i)) for i in range(50) for g in "abc"], "k string, x double, y double")
    for row in summarize_levels(df, ["k"], [["k"], []], central()).collect():
        assert (row["std"], row["var"], row["cov"]) == (0.0, 0.0, 0.0)
        assert row["skew"] is row["kurt"] is row["corr"] is None
    empty = summarize_levels(df.filter("false"), ["k"], [["k"], []], central()).collect()
    assert empty == [] and summarize(df.filter("false"), [], central()).first()["std"] is None


def test_moments_do_not_expand_rows(spark, table):
    found = summarize_levels(table, ["a", "b"], [["a", "b"], ["a"], []], [*central(), M.total("t", "x")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.count("InMemoryRelation") == 1


def test_modes_at_levels_and_running(spark, table):
    rows = table.select("a", "b", "v").collect()

    def best(values):
        return min(set(values), key=lambda v: (-values.count(v), v), default=None)

    levels = [["a", "b"], ["b"], []]
    got = summarize_levels(table, ["a", "b"], levels, [M.mode("m", "v"), M.volume("n")]).collect()
    assert len(got) == 13 + 5 + 1
    for r in got:
        inside = [x.v for x in rows if (r[LEVEL] & 2 or x.a == r.a) and (r[LEVEL] & 1 or x.b == r.b)]
        assert r.m == best(inside)
    order = [3, 8, 1]
    for i, r in enumerate(sorted(cumulative(table, "b", order, [M.mode("m", "v")]).collect(), key=lambda r: order.index(r.b))):
        assert r.m == best([x.v for x in rows if x.b in order[: i + 1]])
    plan = level_modes(table, "v", ["a", "b"], levels)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 1


def reference_autocorrelation(rows):
    ordered = [r.x for r in sorted(rows, key=lambda r: (r.day, r.x is not None, r.x or 0.0))]
    pairs = [(b, a) for a, b in zip(ordered, ordered[1:]) if a is not None and b is not None]
    if len(pairs) < 2:
        return None
    n = len(pairs)
    mx, my = sum(p[0] for p in pairs) / n, sum(p[1] for p in pairs) / n
    sx, sy = sum((p[0] - mx) ** 2 for p in pairs), sum((p[1] - my) ** 2 for p in pairs)
    return sum((p[0] - mx) * (p[1] - my) for p in pairs) / math.sqrt(sx * sy) if sx and sy else None


@pytest.mark.parametrize("limit", [1, 100_000])
def test_autocorrelation_merges_runs(spark, table, limit):
    rows = table.collect()
    metric = [M.autocorrelation("r", "x", ["day"], limit=limit)]
    # Days repeat: ties are ordered by the value, wherever rows come from.
    for seed in (1, 2):
        mixed = table.orderBy(F.xxhash64("i", F.lit(seed))).repartition(2 + seed)
        for r in summarize_levels(mixed, ["b"], [["b"], []], metric).collect():
            expected = reference_autocorrelation([x for x in rows if r[LEVEL] or x.b == r.b])
            assert same(r.r, expected)
        order = [2, 8, 9, 0]
        for r in cumulative(mixed, "b", order, metric).collect():
            assert same(r.r, reference_autocorrelation([x for x in rows if x.b in order[: order.index(r.b) + 1]]))


def test_products_and_sketches_roll_up(spark):
    df = spark.range(60_000).select(
        (F.col("id") % 3).alias("a"), (F.col("id") % 7).alias("b"), (F.col("id") % 20_000).cast("string").alias("t"),
        F.when(F.col("id") < 10, F.lit(2.0)).alias("z"),
    )
    metrics = [M.distinct_count("d", "t", approximate=True), M.product("p", "z"), M.volume("n")]
    for r in summarize_levels(df, ["a", "b"], [["a", "b"], ["a"], ["b"], []], metrics).collect():
        inside = df.filter((F.lit(bool(r[LEVEL] & 2)) | (F.col("a") == F.lit(r.a))) & (F.lit(bool(r[LEVEL] & 1)) | (F.col("b") == F.lit(r.b))))
        d, p = inside.agg(F.count_distinct("t"), F.coalesce(F.product("z"), F.lit(1.0))).first()
        assert abs(r.d - d) <= 0.08 * d and r.p == p
    for r in cumulative(df, "a", [2, 5, 0], metrics).collect():
        assert abs(r.d - 20_000) <= 1600 and r.p == {2: 8.0, 5: 8.0, 0: 128.0}[r.a]


def test_running_total_size_without_rows_before(spark, table):
    metric = [M.overall_approval_rate("rate", "a", ["p"])]
    rows = {r.b: r.rate for r in cumulative(table, "b", [77, 0], metric).collect()}
    hits = table.filter("b = 0 and a = 'p'").count()
    assert rows == {77: 0.0, 0: pytest.approx(hits / (ROWS + 1))}
