import math
import random

import pytest
from pyspark.sql import functions as F

from bandwise.operators.bands import (
    Band,
    assign,
    assign_lookup,
    assign_numeric,
    bands_frame,
    check_category_bands,
    check_numeric_bands,
    check_variable,
    clip_outer_bounds,
    collect_categories,
    describe_bands,
    describe_categories,
    even_category_bands,
    quantile_bands,
)
from bandwise.operators.loss_bands import (
    LossRate,
    grid_bands,
    loss_rate_bands,
    loss_rate_categories,
    rate_table,
    risk_direction,
    value_step,
)
from bandwise.operators.segments import (
    INF,
    Segment,
    collect_segments,
    contiguous_lower_rates,
    default_segments,
    portfolio_scalar,
    scale_factor,
    segment_by_rate,
    segment_frame,
    split_equal_rates,
)


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_quantile_bands(spark):
    df = spark.createDataFrame([(v,) for v in range(10, 90, 10)], "score int")
    bands = quantile_bands(df, "score", 4)
    assert [b.lower for b in bands] == [-INF, 27.5, 45.0, 62.5]
    assert bands[-1].upper == INF
    assert quantile_bands(df, "score", 0) == []
    assert [b.upper for b in quantile_bands(df, "score", 4, limit=2)] == [27.5, 45.0, 62.5, INF]


def test_even_category_bands(spark):
    df = spark.createDataFrame([(c,) for c in "ebacdac"] + [(None,)], "grade string")
    bands = collect_categories(even_category_bands(df, "grade", 3))
    assert [b.categories for b in bands] == [{"a", "b"}, {"c", "d"}, {"e"}]
    few = spark.createDataFrame([("x",), ("y",), ("x",)], "bucket string")
    bands = collect_categories(even_category_bands(few, "bucket", 4))
    assert [b.categories for b in bands] == [{"x"}, {"y"}, set(), set()]
    assert describe_categories(bands)[0] == "x"
    with pytest.raises(ValueError):
        collect_categories(even_category_bands(df, "grade", 3), limit=2)


def test_assignment_edges(spark):
    df = spark.createDataFrame(
        [(x,) for x in (None, math.nan, -1.0, 0.0, 5.0, 5.1, 10.0, 11.0)], "x double"
    )
    bands = [Band(1, 0, 5), Band(2, 5, 10)]
    expected = [None, None, None, None, 1, 2, 2, None]
    assert values(df, assign(F.col("x"), bands)) == expected
    overlapping = [Band(1, 0, 7), Band(2, 5, 10)]
    assert values(df, assign(F.col("x"), overlapping)) == [None, None, None, None, 1, 1, 2, None]
    assert values(df, assign(F.col("x"), [Band(3, None, math.nan)])) == [None, None, 3, 3, 3, 3, 3, 3]


def test_many_bands_agree_with_few(spark):
    rng = random.Random(2)
    cuts = sorted(rng.sample(range(1000), 60))
    bands = [Band(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if i % 5]
    xs = [float(c) for c in cuts] + [rng.uniform(-5, 1005) for _ in range(300)] + [math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    expected = [next((b.id for b in bands if b.lower < x <= b.upper), None) for x in xs]
    assert values(df, assign_numeric(F.col("x"), bands)) == expected


def test_categories(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    bands = [Band(0, categories=frozenset({"a"})), Band(1, categories=frozenset({"a", "b"}))]
    assert values(df, assign(F.col("c"), bands)) == [0, 1, None, None]
    lookup = spark.createDataFrame([(0, "a"), (1, "a"), (1, "b"), (2, None)], "band_id int, category string")
    got = assign_lookup(df, "c", lookup, "band").collect()
    assert {r.c: r.band for r in got} == {"a": 0, "b": 1, "z": None, None: None}


def test_clipping():
    bands = [Band(1, 10, 20), Band(0, -1, 10)]
    kept = clip_outer_bounds(bands, 0, 30)
    assert [(b.lower, b.upper) for b in kept] == [(10, 30), (-1, 10)]
    exact = clip_outer_bounds(bands, 0, 30, include_min=False)
    assert exact[1].lower == 0
    assert clip_outer_bounds([Band(0)], 0, 30)[0] == Band(0, 0, 30)
    assert clip_outer_bounds(bands, None, None) == bands


def test_checks(spark):
    bands = [Band(0, 1, 3), Band(1, 2, 5), Band(2, 9, 9), Band(3, 0, 1)]
    found = {(r.severity, r.band_id, r.problem) for r in check_numeric_bands(bands_frame(spark, bands)).collect()}
    assert found == {
        ("warning", 2, "lower >= upper"), ("error", 0, "overlap"),
        ("warning", None, "lower bounds not monotonic"), ("warning", None, "upper bounds not monotonic"),
    }
    good = bands_frame(spark, [Band(0, 5, 9), Band(1, 1, 5)])
    assert check_numeric_bands(good).count() == 0
    assert describe_bands(good).orderBy("band_id").first().band == "(5.0 - 9.0]"
    table = spark.createDataFrame([(0, "a"), (1, "a"), (2, None)], "band_id int, category string")
    found = {(r.severity, r.band_id, r.category) for r in check_category_bands(table).collect()}
    assert found == {("warning", 2, None), ("error", 1, "a")}


def test_check_variable(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(30)], "c string, x int")
    assert check_variable(df, "x", numeric=True) == []
    assert len(check_variable(df, "c", numeric=True)) == 2
    assert check_variable(df, "c", numeric=False, max_categories=30) == []
    assert check_variable(df, "nothing", numeric=True) != []


def test_segments(spark):
    segments = default_segments()
    frame = segment_frame(spark, segments)
    lower = [s.lower_rate for s in collect_segments(contiguous_lower_rates(frame))]
    assert lower == [0, 0, 0.02, 0.02, 0.04, 0.04, 0.07, 0.07, 0.1, 0.1]
    upper = [s.upper_rate for s in collect_segments(split_equal_rates(frame))]
    assert upper == pytest.approx([0.01, 0.02, 0.03, 0.04, 0.055, 0.07, 0.085, 0.1, 0.115, 0.13])
    three = [Segment(0, "Low", 0, 0.03), Segment(1, "Med", 0.03, 0.07), Segment(2, "High", 0.07, INF)]
    df = spark.createDataFrame([(r,) for r in (0.01, 0.03, 0.05, 0.07, 0.12)], "r double")
    assert values(df, segment_by_rate(F.col("r"), three)) == ["Low", "Med", "Med", "High", "High"]
    mafs = spark.createDataFrame([(m,) for m in (0.4, 0.6, 1.0)], "maf double")
    assert values(mafs, scale_factor(F.col("maf"), 2.0)) == [1.0, 1.2, 2.0]
    assert portfolio_scalar(0.1, 0.25) == 2.5
    assert portfolio_scalar(None, 0.2) == portfolio_scalar(0.0, 0.2) == 1.0


def test_value_step():
    assert [value_step(g) for g in (None, 0.0, math.inf, 1.0, 37.0, 0.25, 0.5)] == [1, 1, 1, 1, 10, 0.01, 0.1]


# --- loss-rate banding against a plain walk over the values ----------------


def walk(rates, limits, delta):
    """Value by value: hand over to later segments until one takes the value."""
    ordered = sorted(rates)
    last, k = [ordered[0] - delta] * len(limits), 0
    for v in ordered:
        num, den = rates[v]
        rate = num / den if den else (math.inf if num else math.nan)
        while k < len(limits) and not rate < limits[k]:
            k += 1
        if k == len(limits):
            break
        for later in range(k, len(limits)):
            last[later] = v
    bounds, lower = [], ordered[0] - delta
    for upper in last:
        bounds.append((lower, upper))
        lower = upper
    if bounds[-1][1] < ordered[-1]:
        bounds[-1] = (bounds[-1][0], ordered[-1])
    return bounds


def random_loans(rng, groups=1):
    rows = []
    for g in range(groups):
        for v in rng.sample(range(40), rng.randrange(1, 15)):
            for _ in range(rng.randrange(1, 4)):
                rows.append((g, v, rng.choice([0.0, 0.0, 1.0, 2.0]), rng.choice([0.0, 5.0, 20.0, 40.0])))
    return rows


def rates_of(rows, sign=1):
    found = {}
    for _, v, num, den in rows:
        n, d = found.get(sign * v, (0.0, 0.0))
        found[sign * v] = (n + num, d + den)
    return found


def smallest_step(vs):
    ordered = sorted(set(vs))
    return value_step(float(min((b - a for a, b in zip(ordered, ordered[1:])), default=0)) or None)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("rising", [True, False])
def test_loss_rate_bands(spark, seed, rising):
    rng = random.Random(seed)
    rows = random_loans(rng)
    df = spark.createDataFrame([*rows, (0, None, 1.0, 1.0)], "g int, v int, num double, den double")
    segments = [Segment(i, str(i), 0, rng.choice([0.02, 0.05, 0.1, 0.2, INF])) for i in range(4)]
    loss = LossRate("num", "den", use_scalar=False)
    delta = smallest_step([r[1] for r in rows])
    expected = walk(rates_of(rows, 1 if rising else -1), [s.upper_rate for s in segments], delta)
    if not rising:
        expected = [(-hi - delta, -lo - delta) for lo, hi in expected]
    got = loss_rate_bands(df, "v", segments, loss, high_is_risky=rising, limit=rng.choice([1, 1000]))
    assert [(b.lower, b.upper) for b in got] == expected
    assert [b.id for b in got] == [0, 1, 2, 3]


def test_bands_partition_the_range(spark):
    rng = random.Random(4)
    df = spark.createDataFrame(random_loans(rng), "g int, v int, num double, den double")
    segments = collect_segments(split_equal_rates(segment_frame(spark, default_segments())))
    bands = loss_rate_bands(df, "v", segments, LossRate("num", "den", scalar=1.4), True)
    assert all(a.upper == b.lower for a, b in zip(bands, bands[1:]))
    assert df.filter(assign(F.col("v"), bands).isNull()).count() == 0


def test_banding_refuses_bad_input(spark):
    df = spark.createDataFrame([(1, "a", 1.0, -1.0)], "v int, c string, num double, den double")
    segments = [Segment(0, "a", 0, 0.1), Segment(1, "b", 0.1, INF)]
    loss = LossRate("num", "den")
    with pytest.raises(ValueError, match="negative"):
        loss_rate_bands(df, "v", segments, loss)
    with pytest.raises(TypeError):
        loss_rate_bands(df, "c", segments, loss)
    with pytest.raises(TypeError):
        loss_rate_categories(df, "v", segments, loss)
    with pytest.raises(ValueError):
        LossRate("num", mob=0)
    empty = loss_rate_bands(df.filter("v > 9"), "v", segments, loss)
    assert [(b.lower, b.upper) for b in empty] == [(0, 0), (0, 0)]


def test_direction(spark):
    rising = [(0, v, v * 0.01, 1.0) for v in range(1, 20)]
    falling = [(0, v, (20 - v) * 0.01, 1.0) for v in range(1, 20)]
    for rows, expected in ((rising, True), (falling, False), ([(0, 1, 0.0, 0.0)], False)):
        df = spark.createDataFrame(rows, "g int, v int, num double, den double")
        assert risk_direction(rate_table(df, "v", "num", "den")) is expected


def test_loss_rate_categories(spark):
    rows = [("a", 0.0, 10.0), ("b", 1.0, 10.0), ("c", 9.0, 10.0), ("d", 1.0, 0.0), (None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, num double, den double")
    segments = [Segment(0, "x", 0, 0.05), Segment(1, "y", 0, 0.2), Segment(2, "z", 0, 0.5)]
    got = loss_rate_categories(df, "c", segments, LossRate("num", "den", use_scalar=False)).collect()
    assert {r.category: r.band_id for r in got} == {"a": 0, "b": 1, "c": 2, "d": 2}


@pytest.mark.parametrize("seed", range(4))
def test_grid_bands(spark, seed):
    rng = random.Random(100 + seed)
    rows = random_loans(rng, groups=3)
    df = spark.createDataFrame([*rows, (None, 3, 1.0, 1.0)], "g int, v int, num double, den double")
    segments = [Segment(i, str(i), 0, t) for i, t in enumerate((0.03, 0.06, 0.12, INF))]
    rising = rng.choice([True, False])
    sign = 1 if rising else -1
    points = set()
    for parent in range(3):
        mine = [r for r in rows if r[0] == parent]
        limits = [s.upper_rate for s in segments[max(0, parent - 1) : parent + 2]]
        delta = smallest_step([r[1] for r in mine])
        for lo, hi in walk(rates_of(mine, sign), limits, delta):
            points |= {lo, hi} if rising else {-hi - delta, -lo - delta}
    ordered = sorted(points)
    expected = list(zip(ordered, ordered[1:]))
    got = grid_bands(df, "v", "g", segments, LossRate("num", "den", use_scalar=False), 1, 1, rising)
    assert [(b.lower, b.upper) for b in got] == (expected if rising else expected[::-1])
