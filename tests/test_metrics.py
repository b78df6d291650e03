import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from bandwise.operators import metrics as M
from bandwise.operators.quantiles import (
    INTERPOLATIONS,
    column_quantiles,
    group_quantiles,
    min_gap,
    most_frequent,
)
from bandwise.operators.summarize import (
    LEVEL,
    cumulative,
    join_summaries,
    summarize,
    summarize_levels,
)
from bandwise.sources.union import union_sources


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1.0, 2.0), (2.0, 3.0), (3.0, 5.0), (4.0, 8.0), (5.0, 13.0)]
    return spark.createDataFrame(rows, "a double, b double")


def value(df, metric, **kw):
    return summarize(df, [], [metric], **kw).first()[0]


def test_aggregates(spark, numbers):
    a = [1.0, 2.0, 3.0, 4.0, 5.0]
    four = numbers.limit(4)
    assert value(numbers, M.std("m", "a")) == pytest.approx(1.5811, abs=1e-4)
    assert value(numbers, M.variance("m", "a")) == pytest.approx(2.5)
    assert value(numbers, M.product("m", "a")) == pytest.approx(120)
    assert value(numbers, M.standard_error("m", "a")) == pytest.approx(0.7071, abs=1e-4)
    assert value(numbers, M.autocorrelation("m", "a", ["a"])) == pytest.approx(1.0)
    assert value(numbers, M.median("m", "a")) == statistics.median(a)
    assert value(numbers, M.skewness("m", "a")) == pytest.approx(0)
    assert value(numbers, M.kurtosis("m", "a")) == pytest.approx(-1.3)
    assert value(numbers, M.distinct_count("m", "a")) == 5
    assert value(four, M.quantile("m", "a", 0.75)) == 3.0
    assert value(four, M.quantile("m", "a", 0.75, "linear")) == 3.25
    assert value(numbers, M.covariance("m", "a", "b")) == pytest.approx(6.75)


def test_mode_all_any(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.0, 3.0, 3.0, 3.0)], "x double")
    assert value(df, M.mode("m", "x")) == 3.0
    ties = spark.createDataFrame([(v,) for v in (5, 2, 5, 2, 9)], "x int")
    assert most_frequent(ties, "x").first()["mode"] == 2
    flags = spark.createDataFrame([(1,), (0,), (1,)], "x int")
    assert value(flags, M.every("m", "x")) is False
    assert value(flags, M.some("m", "x")) is True
    assert value(flags, M.every("m", "x"), where="x > 5") is True
    assert value(flags, M.some("m", "x"), where="x > 5") is False


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([("a", None), ("a", None)], "k string, x double")
    got = summarize(
        df, ["k"],
        [M.total("t", "x"), M.mean("m", "x"), M.value_count("c", "x"), M.row_count("n"),
         M.distinct_count("d", "x"), M.median("md", "x"), M.mode("mo", "x")],
    ).first()
    assert tuple(got)[1:] == (0.0, None, 0, 2, 1, None, None)
    assert value(df, M.total("t", "x"), where="k = 'z'") == 0.0
    assert math.isnan(value(df, M.quotient("q", "x", "x")))


def test_balances(spark):
    rows = [("A", 1, 100), ("A", 0, 100), ("B", 2, 100), ("B", 3, 100), ("C", 4, 100)]
    df = spark.createDataFrame(rows, "segment string, bad long, bal long")
    metrics = [M.volume(), M.dollar_bad_rate("rate", "bad", "bal")]
    assert tuple(summarize(df, [], metrics).first()) == (5, pytest.approx(2.0))
    got = cumulative(df, "segment", ["A", "B", "C"], metrics).collect()
    assert [r.Volume for r in sorted(got, key=lambda r: r.segment)] == [2, 4, 5]


def two_sources(spark, dev, test, schema):
    return union_sources(
        {"dev": spark.createDataFrame(dev, schema), "test": spark.createDataFrame(test, schema)}
    )


def test_sources_are_isolated(spark):
    df = two_sources(spark, [("A", 1), ("B", 2)], [("B", 3), ("C", 4)], "group string, val int")
    metrics = [M.volume("d").on("dev"), M.volume("t").on("test")]
    got = sorted(tuple(r) for r in summarize(df, ["group"], metrics).collect())
    assert got == [("A", 1, None), ("B", 1, 1), ("C", None, 1)]
    assert tuple(summarize(df, [], metrics).first()) == (2, 2)
    both = join_summaries(
        [summarize(df, ["group"], [m], drop_null_keys=False) for m in metrics], ["group"]
    )
    assert sorted(tuple(r) for r in both.collect()) == got


def test_null_keys(spark):
    df = two_sources(spark, [(None, 1), ("B", 2)], [(None, 3)], "group string, val int")
    one = [M.volume("d")]
    two = [M.volume("d").on("dev"), M.volume("t").on("test")]
    assert {r.group for r in summarize(df, ["group"], one).collect()} == {None, "B"}
    assert {r.group for r in summarize(df, ["group"], two).collect()} == {"B"}
    kept = summarize(df, ["group"], two, drop_null_keys=False).collect()
    assert {r.group: (r.d, r.t) for r in kept} == {None: (1, 1), "B": (1, None)}


def test_no_sources_means_no_rows(spark):
    df = two_sources(spark, [("A", 1)], [("B", 3)], "group string, val int")
    assert tuple(summarize(df, [], [M.volume("n").on()]).first()) == (0,)


def test_cumulative_over_sources(spark):
    df = two_sources(
        spark, [("T1", 10), ("T2", 20), ("T3", 30)], [("T1", 100), ("T2", 200), ("T4", 5)],
        "tier string, count int",
    )
    metrics = [M.total("d", "count").on("dev"), M.total("t", "count").on("test")]
    got = cumulative(df, "tier", ["T1", "T2", "T3"], metrics).collect()
    assert sorted(tuple(r) for r in got) == [("T1", 10, 100), ("T2", 30, 300), ("T3", 60, 300)]


def test_cumulative_last_row_is_the_whole(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), (F.col("id") * 7 % 31).cast("double").alias("x"))
    metrics = [M.total("t", "x"), M.std("s", "x"), M.median("m", "x"), M.smallest("lo", "x")]
    rows = {r.k: r for r in cumulative(df, "k", [9, 3, 1, 4, 0, 2], metrics).collect()}
    whole = summarize(df, [], metrics).first()
    assert tuple(rows[2])[1:] == pytest.approx(tuple(whole))
    assert tuple(rows[9])[1:] == (0.0, None, None, None)


def test_filter_and_derived_keys(spark):
    rows = [("A", 10, 1), ("A", 20, 9), ("B", 30, 9), ("B", 40, 9), ("C", 50, 9)]
    df = spark.createDataFrame(rows, "group string, val int, score int")
    got = summarize(df, ["group"], [M.total("v", "val")], where="score > 5")
    assert {r.group: r.v for r in got.collect()} == {"A": 20, "B": 70, "C": 50}
    derived = {"double": F.col("val") * 2, "band": "CASE WHEN double > 45 THEN 'hi' ELSE 'lo' END"}
    got = summarize(df, ["band"], [M.total("v", "val")], with_columns=derived)
    assert {r.band: r.v for r in got.collect()} == {"lo": 30, "hi": 120}
    assert summarize(df, ["group"], []).count() == 0
    with pytest.raises(ValueError):
        summarize(df, [], [M.volume("x"), M.volume("x")])


def test_levels_agree_with_separate_summaries(spark):
    df = spark.range(200).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("a"), (F.col("id") % 4).alias("b"),
        (F.col("id") * 13 % 47).cast("double").alias("x"),
    )
    for metrics in (
        [M.total("t", "x"), M.volume("n"), M.overall_approval_rate("o", "b", [1])],
        [M.total("t", "x"), M.std("s", "x"), M.quantile("q", "x", 0.3)],
    ):
        found = summarize_levels(df, ["a", "b"], [["a", "b"], ["a"], ["b"], []], metrics)
        names = [m.name for m in metrics]
        by_level = {}
        for r in found.collect():
            by_level.setdefault(r[LEVEL], {})[(r.a, r.b)] = [r[n] for n in names]
        for level, keys in ((0, ["a", "b"]), (1, ["a"]), (2, ["b"]), (3, [])):
            rows = summarize(df, keys, metrics).collect()
            expected = {
                (r["a"] if "a" in keys else None, r["b"] if "b" in keys else None): [r[n] for n in names]
                for r in rows
            }
            assert by_level[level].keys() == expected.keys()
            for k, v in expected.items():
                assert by_level[level][k] == pytest.approx(v)


def reference_quantile(values, fraction, how):
    v = sorted(values)
    h = (len(v) - 1) * fraction
    low, high = v[math.floor(h)], v[math.ceil(h)]
    return {
        "linear": low + (high - low) * (h - math.floor(h)),
        "lower": low, "higher": high, "midpoint": (low + high) / 2,
        "nearest": v[math.floor(h + 0.5)],
    }[how]


@pytest.mark.parametrize("limit", [10_000, 20])
@pytest.mark.parametrize("how", INTERPOLATIONS)
def test_quantiles_of_skewed_groups(spark, limit, how):
    """A third of the rows share one value; one group holds most rows."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.8 else rng.choice("ab"), 5.0 if rng.random() < 0.33 else rng.gauss(0, 9)) for _ in range(900)]
    rows += [("hot", None), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.quantiles for r in group_quantiles(df, "x", fractions, ["k"], how, limit).collect()}
    for k in ("hot", "a", "b", None):
        values = [x for key, x in rows if key == k and x is not None]
        assert got[k] == pytest.approx([reference_quantile(values, q, how) for q in fractions])


def test_quantiles_of_several_columns(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.randrange(5), None) for _ in range(300)]
    df = spark.createDataFrame(rows, "a double, b int, c double")
    fractions = [0.25, 0.9]
    for limit in (10_000, 50):
        got = column_quantiles(df, ["a", "b", "c"], fractions, limit)
        for i, c in enumerate("ab"):
            expected = [reference_quantile([r[i] for r in rows], q, "linear") for q in fractions]
            assert got[c] == pytest.approx(expected)
        assert got["c"] == [None, None]


def test_autocorrelation_in_ranges(spark):
    rng = random.Random(5)
    # Most rows share the first ordering column.
    rows = [(rng.choice("ab"), 1 if rng.random() < 0.7 else rng.randrange(9), i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, day int, i int, x double").repartition(5)
    whole = summarize(df, ["k"], [M.autocorrelation("r", "x", ["day", "i"])]).collect()
    ranged = summarize(df, ["k"], [M.autocorrelation("r", "x", ["day", "i"], limit=50)]).collect()
    assert {r.k: r.r for r in ranged} == pytest.approx({r.k: r.r for r in whole})
    with pytest.raises(ValueError):
        M.autocorrelation("r", "x", [])


def test_min_gap(spark):
    rng = random.Random(1)
    values = [rng.randrange(100000) for _ in range(400)] + [7, 7]
    df = spark.createDataFrame([(v,) for v in values], "x int")
    ordered = sorted(set(values))
    expected = min(b - a for a, b in zip(ordered, ordered[1:]))
    assert min_gap(df, "x") == expected == min_gap(df, "x", limit=10)
    assert min_gap(df.filter("x = 7"), "x") is None
