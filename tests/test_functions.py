import math

import pytest
from pyspark.sql import functions as F

from bandwise.functions.arithmetic import (
    floor_divide,
    floor_divide_real,
    ln,
    log1p,
    log10,
    modulo,
    power,
    ratio,
)
from bandwise.functions.labels import format_value, label_codes, percentile_label, quantile_label, strength_label
from bandwise.functions.predicates import (
    above_population,
    all_of,
    between_chain,
    compare,
    either,
    keep,
)
from bandwise.functions.rowwise import row_max, row_mean, row_median, row_min, row_std, row_sum


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    "n, d, expected",
    [(1.0, 0.0, math.inf), (-1.0, 0.0, -math.inf), (6.0, 4.0, 1.5), (None, 0.0, None), (1.0, None, None)],
)
def test_ratio(spark, n, d, expected):
    got = one(spark, ratio(F.lit(n).cast("double"), F.lit(d).cast("double")))[0]
    assert got == expected


def test_ratio_of_zeros_is_nan(spark):
    assert math.isnan(one(spark, ratio(F.lit(0), F.lit(0)))[0])
    assert math.isnan(one(spark, ratio(F.lit(math.nan), F.lit(0)))[0])


@pytest.mark.parametrize("a, b", [(7, 3), (-7, 3), (7, -3), (-7, -3), (6, 3)])
def test_floor_division(spark, a, b):
    got = one(
        spark, floor_divide(F.lit(a), F.lit(b)), modulo(F.lit(a), F.lit(b)),
        floor_divide_real(F.lit(float(a)), F.lit(float(b))),
    )
    assert tuple(got) == (a // b, a % b, float(a // b))


def test_zero_divisors(spark):
    assert tuple(one(spark, floor_divide(F.lit(1), F.lit(0)), modulo(F.lit(1), F.lit(0)))) == (None, None)
    assert one(spark, floor_divide_real(F.lit(1), F.lit(0)))[0] == math.inf


def test_logarithms_outside_domain(spark):
    got = one(spark, ln(F.lit(0)), log10(F.lit(0)), log1p(F.lit(-1)), power(F.lit(2), F.lit(3)))
    assert tuple(got) == (-math.inf, -math.inf, -math.inf, 8.0)
    assert all(math.isnan(v) for v in one(spark, ln(F.lit(-1)), log10(F.lit(-1)), log1p(F.lit(-2))))


def test_row_wise(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (10.0, 20.0, None), (None, None, None)], "a double, b double, c double")
    c = ["a", "b", "c"]
    rows = df.select(row_sum(*c), row_mean(*c), row_median(*c), row_min(*c), row_max(*c), row_std(*c)).collect()
    assert tuple(rows[0])[:5] == (9.0, 3.0, 2.0, 1.0, 6.0)
    assert rows[0][5] == pytest.approx(math.sqrt(7))
    assert tuple(rows[1])[:5] == (30.0, 15.0, 15.0, 10.0, 20.0)
    assert tuple(rows[2]) == (0.0, None, None, None, None, None)
    with pytest.raises(ValueError):
        row_sum()


def test_predicates(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0), (4, 2.0)], "id int, x double")

    def ids(p):
        return [r.id for r in keep(df, p).orderBy("id").collect()]

    assert ids("x > 1") == [3, 4]
    assert ids(~F.col("x").isin(1.0)) == [3, 4]
    assert ids(F.col("x").isNull()) == [2]
    assert ids(between_chain(F.lit(1), "<=", F.col("x"), "<", F.lit(3))) == [1, 4]
    assert ids(either(F.col("x") > 1, F.col("id") > 3)) == [3]
    assert ids(all_of([])) == [1, 2, 3, 4]
    assert ids(None) == [1, 2, 3, 4]
    assert [r.id for r in above_population(df, "x", F.avg("x")).collect()] == [3]
    with pytest.raises(ValueError):
        between_chain(F.col("x"), "<")


def test_text_predicates(spark):
    df = spark.createDataFrame([("Alice",), ("Bob",), ("Charlie",)], "name string")
    got = [[r.name for r in df.filter(p).collect()] for p in ("name rlike 'li'", "startswith(name, 'A')", "endswith(name, 'e') and name like 'C%'")]
    assert got == [["Alice", "Charlie"], ["Alice"], ["Charlie"]]


def test_text_is_not_compared_with_numbers(spark):
    df = spark.createDataFrame([(1.0, "a", True)], "val double, name string, flag boolean")
    for column, value in (("val", "a"), ("name", 1), ("flag", "x")):
        with pytest.raises(TypeError):
            compare(df, column, "==", value)
    with pytest.raises(ValueError):
        compare(df, "val", "~", 1)
    assert df.filter(compare(df, "name", "==", "a")).count() == 1


def test_labels(spark):
    got = one(
        spark,
        format_value(F.lit(1234.567)), format_value(F.lit(12.3), 1, False, True),
        format_value(F.lit(math.nan)), format_value(F.lit(-math.inf)),
        label_codes(F.lit(2), {1: "a", 2: "b"}), label_codes(F.lit(3), {1: "a"}),
        percentile_label(F.lit(0.25)), quantile_label(F.lit(0.99)),
        strength_label(F.lit(0.05)), strength_label(F.lit(0.5)),
    )
    assert tuple(got) == (
        "1,234.57", "12.3%", None, "-inf", "b", None, "25.0%", "99th Percentile", "weak", "strong",
    )
