import random

import pytest
from pyspark.sql import functions as F

from bandwise.operators import metrics as M
from bandwise.operators.bands import Band, bands_frame
from bandwise.operators.bounded import bounded_rows
from bandwise.operators.grid import (
    assign_targets,
    collect_grid,
    describe_grid,
    grid_frame,
    merge_equal_bands,
    merge_equal_categories,
    monotone_grid,
)
from bandwise.operators.information_value import information_value, iv_ranking
from bandwise.operators.loss_bands import LossRate
from bandwise.operators.outliers import outlier_counts, outlier_rule
from bandwise.operators.profile import box_plot, distribution_profile, filter_impact
from bandwise.operators.segments import INF, Segment
from bandwise.operators.summarize import summarize
from bandwise.plans.build import child_step, root_step
from bandwise.plans.chain import Step, score, scoring_sql
from bandwise.plans.tables import (
    Scaling,
    cell_table,
    compare_chains,
    dimension_candidates,
    formatted,
    pivot_long,
    pivot_wide,
    segment_table,
    sorted_totals_last,
)

SEGMENTS = [Segment(i, n, 0.0, t) for i, (n, t) in enumerate((("A", 0.1), ("B", 0.3), ("C", INF)))]
LOSS = LossRate("bad", "bal", use_scalar=False)


@pytest.fixture(scope="module")
def book(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        root, child = rng.randrange(1, 30), rng.randrange(1, 12)
        bal = rng.uniform(10, 100)
        bad = bal * (root / 80 + child / 60) if rng.random() < 0.7 else 0.0
        rows.append((i, root, child, rng.choice(["x", "y", "z", "it's"]), bad, bal, rng.choice(["r", None])))
    return spark.createDataFrame(
        rows, "id int, root int, child int, bucket string, bad double, bal double, region string"
    ).cache()


@pytest.fixture(scope="module")
def chain(book):
    root = root_step(book, "root", SEGMENTS, LOSS)
    child = child_step(book, [root], "child", SEGMENTS, LOSS, 1, 1)
    last = child_step(book, [root, child], "bucket", SEGMENTS, LOSS, 1, 1)
    return [root, child, last]


def test_targets_stay_within_reach(chain):
    for step in chain[1:]:
        assert step.grid
        assert all(abs(target - parent) <= 1 for (_, parent), target in step.grid.items())


def test_every_row_has_a_segment(book, chain):
    scored = score(book, chain)
    assert scored.filter("segment is null").count() == 0
    assert scored.columns == [*book.columns, "segment_1", "segment_2", "segment_3", "segment"]


def test_score_equals_generated_sql(spark, book, chain):
    text = spark.sql(scoring_sql(chain, "{book}"), book=book).select("id", "segment")
    direct = score(book, chain).select("id", "segment")
    assert text.exceptAll(direct).count() == direct.exceptAll(text).count() == 0


def test_score_follows_the_first_band_and_grid(book, chain):
    root, child = chain[0], chain[1]
    for r in score(book, chain).limit(100).collect():
        parent = next(b.id for b in root.bands if b.lower < r.root <= b.upper)
        band = next(b.id for b in child.bands if b.lower < r.child <= b.upper)
        assert (r.segment_1, r.segment_2) == (parent, child.grid[band, parent])


def test_disabled_bands_leave_rows_unassigned(book, chain):
    step = Step(chain[1].variable, chain[1].bands, chain[1].grid, frozenset({chain[1].bands[0].id}))
    first = chain[1].bands[0]
    scored = score(book, [chain[0], step])
    inside = (F.col("child") > first.lower) & (F.col("child") <= first.upper)
    assert scored.filter(inside & F.col("segment").isNotNull()).count() == 0
    assert scored.filter(~inside & F.col("segment").isNull()).count() == 0


def test_chain_is_checked(book, chain):
    for bad in ([], [chain[1]], [chain[0], chain[0]], [Step("nothing", chain[0].bands)]):
        with pytest.raises(ValueError):
            score(book, bad)
    with pytest.raises(ValueError):
        root_step(book, "root", [Segment(0, "a", 0, INF)], LOSS)
    with pytest.raises(ValueError):
        root_step(book.withColumn("t", F.col("id").cast("string")), "t", SEGMENTS, LOSS)


def test_steps_without_loss(book):
    root = root_step(book, "bucket", SEGMENTS)
    assert [b.id for b in root.bands] == [0, 1, 2]
    child = child_step(book, [root], "child", SEGMENTS)
    assert len(child.bands) == 10
    assert all(p == t for (_, p), t in child.grid.items())
    assert score(book, [root, child]).filter("segment_1 <> segment").count() == 0


def test_scoring_a_stream(spark, book, chain, tmp_path):
    path = str(tmp_path / "in")
    book.coalesce(2).write.parquet(path)
    stream = score(spark.readStream.schema(book.schema).parquet(path), chain)
    run = (
        stream.select("id", "segment").writeStream.format("memory").queryName("scored_stream")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    run.awaitTermination(60)
    got = spark.table("scored_stream")
    assert got.exceptAll(score(book, chain).select("id", "segment")).count() == 0
    assert got.count() == book.count()


def test_targets_and_merging(spark):
    bands = [Band(i, i, i + 1) for i in range(4)]
    cells = spark.createDataFrame(
        [(0, 0, 0.05), (0, 1, 0.05), (1, 0, 0.05), (1, 1, 0.05), (2, 0, 0.9), (2, 2, 0.01)],
        "band_id int, parent_id int, rate double",
    )
    grid = assign_targets(cells, bands_frame(spark, bands), SEGMENTS, LOSS, 1, 1)
    found = collect_grid(grid)
    assert [found[0, p] for p in range(3)] == [0, 0, 2]
    assert [found[2, p] for p in range(3)] == [1, 1, 1]
    assert [found[3, p] for p in range(3)] == [0, 1, 2]
    merged, smaller = merge_equal_bands(bands_frame(spark, bands), grid)
    rows = [tuple(r) for r in merged.orderBy("band_id").collect()]
    assert rows == [(0, 0.0, 2.0), (1, 2.0, 3.0), (2, 3.0, 4.0)]
    assert [collect_grid(smaller)[1, p] for p in range(3)] == [1, 1, 1]
    flat = collect_grid(monotone_grid(smaller))
    assert [[flat[b, p] for p in range(3)] for b in range(3)] == [[0, 0, 2], [1, 1, 2], [1, 1, 2]]
    shown = describe_grid(smaller, SEGMENTS, {0}).orderBy("band_id").collect()
    assert [tuple(r) for r in shown] == [(1, "B", "B", "B"), (2, "A", "B", "C")]


def test_scale_factor_is_floored_in_grids(spark):
    cells = spark.createDataFrame([(0, 0, 0.09)], "band_id int, parent_id int, rate double")
    bands = bands_frame(spark, [Band(0, 0, 1)])
    small = [Segment(s.id, s.name, s.lower_rate, s.upper_rate, 0.5, 0.5) for s in SEGMENTS]
    large = [Segment(s.id, s.name, s.lower_rate, s.upper_rate, 2.0, 2.0) for s in SEGMENTS]
    for segments, expected in ((small, 0), (large, 1)):
        grid = assign_targets(cells, bands, segments, LossRate("bad", "bal"), 1, 1)
        assert collect_grid(grid)[0, 0] == expected


def test_merging_categories(spark):
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (2, "d")], "band_id int, category string")
    grid = grid_frame(spark, {(0, 0): 1, (0, 1): 1, (1, 0): 0, (1, 1): 1, (2, 0): 1, (2, 1): 1})
    merged, smaller = merge_equal_categories(table, grid)
    assert {r.category: r.band_id for r in merged.collect()} == {"a": 1, "b": 0, "c": 1, "d": 1}
    assert collect_grid(smaller) == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 1}


METRICS = ["Volume", "rate", "mid", "upto"]


def metrics():
    return [
        M.volume(), M.dollar_bad_rate("rate", "bad", "bal"), M.median("mid", "bal"),
        M.volume("upto").running(),
    ]


def test_segment_table(book, chain):
    rows = segment_table(book, chain, SEGMENTS, metrics(), where="id < 500").orderBy("position").collect()
    assert [r.name for r in rows] == ["A", "B", "C", "Total"]
    whole = summarize(book, [], metrics(), where="id < 500").first()
    assert [rows[-1][m] for m in METRICS] == pytest.approx([whole[m] for m in METRICS])
    assert rows[2].upto == 500 == sum(r.Volume or 0 for r in rows[:3])


def test_scaling(book, chain):
    segments = [Segment(s.id, s.name, s.lower_rate, s.upper_rate, m, m) for s, m in zip(SEGMENTS, (3.0, 1.0, 0.1))]
    plain = {r.name: r.rate for r in segment_table(book, chain, segments, metrics()).collect()}
    scaled = {
        r.name: r.rate
        for r in segment_table(book, chain, segments, metrics(), scaling=Scaling(dollar={"rate": 2.0})).collect()
    }
    for name, factor in (("A", 6.0), ("B", 2.0), ("C", 1.0), ("Total", 2.0)):
        if plain[name] is not None:
            assert scaled[name] == pytest.approx(plain[name] * factor)


def test_cell_table_adds_up(book, chain):
    cells = cell_table(book, chain, SEGMENTS, metrics()[:2]).collect()
    count = len(chain[-1].bands)
    assert len(cells) == (count + 1) * (len(SEGMENTS) + 1)
    inner = sum(r.Volume or 0 for r in cells if not r.total_row and not r.total_column)
    corner = next(r for r in cells if r.total_row and r.total_column)
    assert inner == corner.Volume == 600


def test_pivot_totals(book):
    long = pivot_long(book, ["bucket", "region"], ["root"], metrics()[:3])
    total = long.filter("bucket = 'Total' and region = 'Total' and root = 'Total'").collect()
    assert len(total) == 1
    whole = summarize(book, [], metrics()[:3]).first()
    assert [total[0][m] for m in METRICS[:3]] == pytest.approx([whole[m] for m in METRICS[:3]])
    assert long.filter("region is null").count() > 0
    with pytest.raises(ValueError):
        pivot_long(book, [], ["root"], metrics())
    wide = pivot_wide(long, ["bucket"], ["root"], "Volume")
    assert wide.columns[-1] == "Total"
    assert sorted_totals_last(wide, ["bucket"]).collect()[-1].bucket == "Total"


def test_wide_pivot_tells_totals_from_values(spark):
    rows = spark.createDataFrame(
        [("Total", "Total", 8), ("a", None, 20), ("a", "null", 30), (None, "a | b", 5)],
        "row string, key string, n int",
    )
    long = pivot_long(rows, ["row"], ["key"], [M.total("n", "n")])
    wide = pivot_wide(long, ["row"], ["key"], "n", row_level="level")
    found = {(r["level"], r["row"]): r.asDict() for r in wide.collect()}
    assert found[1, "Total"]["Total"] == 63 and found[0, "Total"]["Total"] == 8
    assert (found[0, "a"]["null"], found[0, "a"]['"null"'], found[0, None]['"a | b"']) == (20, 30, 5)
    assert found[1, "Total"]['"Total"'] == 8 and wide.columns[-1] == "Total"
    with pytest.raises(ValueError, match="more than 2"):
        pivot_wide(long, ["row"], ["key"], "n", most_headers=2)


def test_cumulative_metrics_are_refused_without_an_order(book, chain):
    running = [M.volume("running").running()]
    with pytest.raises(ValueError, match="running"):
        pivot_long(book, ["bucket"], ["root"], running)
    with pytest.raises(ValueError, match="running"):
        cell_table(book, chain, SEGMENTS, running)


def test_comparison_is_the_table_of_each_chain(book, chain):
    clashing = book.withColumns({"chain": F.lit("x"), "segment_id": F.lit(1), "position": F.lit(2), "name": F.lit("y")})
    asked = [*metrics()[:2], M.volume("running").running()]
    scaling = Scaling(dollar={asked[1].name: 1.4})
    found = compare_chains(
        clashing, {"one": (chain[:1], SEGMENTS), "all": (chain, SEGMENTS)}, asked, total=True, scaling=scaling
    )
    for name, steps in (("one", chain[:1]), ("all", chain)):
        alone = segment_table(book, steps, SEGMENTS, asked, scaling=scaling)
        got = found.filter(F.col("chain") == name).drop("chain").orderBy("position").collect()
        want = alone.orderBy("position").collect()
        assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in want]
        for g, w in zip(got, want):
            assert tuple(g)[3:] == pytest.approx(tuple(w)[3:])


def test_comparison_and_format(book, chain):
    found = compare_chains(book, {"one": (chain[:1], SEGMENTS), "all": (chain, SEGMENTS)}, metrics()[:2])
    assert found.groupBy("chain").agg(F.sum("Volume").alias("n")).filter("n = 600").count() == 2
    shown = formatted(segment_table(book, chain, SEGMENTS, metrics()), metrics())
    assert shown.filter("name = 'Total'").first().Volume == "600"


def test_dimensions(book):
    found = {r.variable: r.n_unique for r in dimension_candidates(book, book.columns).collect()}
    assert found == {"bucket": 4, "region": 2}


# --- profiling --------------------------------------------------------------


@pytest.mark.parametrize(
    "rows, schema, low, high",
    [
        ([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "v double, t int", 1e-3, 99),
        ([("a", 0), ("a", 1), ("b", 0), ("b", 1)], "v string, t int", -1e-9, 1e-9),
        ([("a", 0), ("a", 0), ("b", 1), ("b", 1)], "v string, t int", 1e-3, 99),
        ([(1, 0), (2, 0)], "v int, t int", 0, 0),
        ([(None, 0), (None, 1)], "v int, t int", 0, 0),
        ([(1, False), (2, True), (1, False), (2, True)], "v int, t boolean", 1e-3, 99),
    ],
)
def test_information_value(spark, rows, schema, low, high):
    df = spark.createDataFrame(rows, schema)
    assert low <= information_value(df, "v", "t").first().iv <= high


def test_iv_ranking_checks(spark, book):
    with pytest.raises(ValueError):
        iv_ranking(spark.createDataFrame([(1, 2)], "v int, t int"), "t", ["v"])
    with pytest.raises(TypeError):
        iv_ranking(book, "bucket", ["root"])
    df = book.withColumn("t", (F.col("bad") > 0).cast("int")).withColumn("name", F.col("id").cast("string"))
    found = iv_ranking(df, "t", ["root", "bucket", "name", "region"]).collect()
    assert sorted(r.variable for r in found if r.reason is None) == ["bucket", "region", "root"]
    assert found[-1].variable == "name" and found[-1].iv is None


def test_outliers(spark):
    df = spark.createDataFrame([(v,) for v in (0, 0, 0, 0, 0, 1, 2, 3, 10, 100)] + [(None,)], "score int")
    rule = outlier_rule(df, "score", ">", percentile=90)
    assert rule.mode == 0 and rule.threshold > 10
    assert df.filter(rule.keeps()).count() == 10
    counts = {r.rule: r.outliers for r in outlier_counts(df, [rule, outlier_rule(df, "score", "<=", value=0)]).collect()}
    assert counts["any rule"] == 1
    assert set(counts.values()) == {0, 1}
    for bad in ({}, {"percentile": 33}, {"percentile": 5, "value": 1}):
        with pytest.raises(ValueError):
            outlier_rule(df, "score", ">", **bad)
    with pytest.raises(ValueError):
        outlier_rule(df, "score", "==", value=1)


def test_profiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [0] * 5 + list(range(1, 100)) + [5000]], "x double")
    assert distribution_profile(df, "x").first().fraction == 0.25
    flipped = df.select((-F.col("x")).alias("x"))
    assert [r.percentile for r in distribution_profile(flipped, "x").collect()][0] == "1.0%"
    box = box_plot(df, "x").first()
    assert (box.n, box.outliers, box.whisker_high) == (105, 1, 99.0)
    empty = box_plot(df.select(F.lit(None).cast("double").alias("x")), "x")
    assert empty.dtypes == box_plot(df, "x").dtypes
    assert empty.first().asDict() == dict.fromkeys(empty.columns) | {"n": 0, "outliers": 0}
    impact = filter_impact(df.union(spark.createDataFrame([(None,)], "x double")), {"big": "x > 50"}).first()
    assert (impact.satisfied, impact.failed) == (50, 55)


def test_queries_near_the_mean_rate_change_bands_and_cells(spark):
    """Otherwise their SQL would also hold if merging and monotone grids did nothing."""
    from bandwise.operators.bands import bands_frame
    from bandwise.operators.grid import collect_grid, grid_frame, merge_equal_bands, monotone_grid
    from catalog import grids

    rows = grids._with_parent(grids.loans(spark, "/root/testdata/sf0.01"))
    bands, targets = grids.found_bands(rows, "tax_pct", grids._NEAR, grids._LOSS, 2, False)
    found = collect_grid(targets)
    merged, grid = merge_equal_bands(bands_frame(spark, bands), grid_frame(spark, found))
    assert merged.count() < len(bands)
    cells = collect_grid(grid)
    assert collect_grid(monotone_grid(grid)) != cells
    assert any(abs(t - p) == 2 for (_, p), t in cells.items()) and any(t != p for (_, p), t in cells.items())
    scaled = collect_grid(grids.found_bands(rows, "tax_pct", grids._SCALED, grids._SCALE, 1, True)[1])
    plain = collect_grid(grids.found_bands(rows, "tax_pct", grids._SCALED, grids._LOSS, 1, True)[1])
    assert scaled != plain


def test_child_step_reads_the_scored_rows_once(spark):
    """The denominator is needed for refusals and cell rates; it is computed once a row."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(value):
        read.add(1)
        return value

    rows = spark.range(2000).select(
        (F.col("id") % 17).cast("double").alias("v"),
        (F.col("id") % 4).alias("g"),
        F.when(F.col("id") * 7919 % 100 < F.col("id") % 17 + 5, 1.0).otherwise(0.0).alias("num"),
        seen(F.lit(1.0)).alias("den"),
    )
    segments = [Segment(i, str(i), 0.0, u) for i, u in enumerate((0.08, 0.12, 0.16, INF))]
    root = Step("g", tuple(Band(i, i - 1.0, float(i)) for i in range(4)))
    step = child_step(rows, [root], "v", segments, LossRate("num", "den", mob=12, use_scalar=False), 1, 1)
    assert len(step.bands) > 1
    assert read.value == 2000


@pytest.fixture(scope="module")
def table_chain(book, chain, tmp_path_factory):
    """The same chain; its last step holds the categories in a table."""
    folder = str(tmp_path_factory.mktemp("categories") / "bucket")
    return [*chain[:2], child_step(book, chain[:2], "bucket", SEGMENTS, LOSS, 1, 1, categories_folder=folder)]


def test_category_table_scores_like_listed_categories(book, chain, table_chain):
    assert table_chain[2].grid == chain[2].grid
    wanted = score(book, chain).select("id", "segment")
    found = score(book, table_chain).select("id", "segment")
    assert found.exceptAll(wanted).count() == 0 and found.count() == wanted.count()
    assert score(book, table_chain).columns == score(book, chain).columns


def test_category_table_in_sql(spark, book, table_chain):
    path = table_chain[2].categories_path
    wanted = score(book, table_chain).select("id", "segment")
    assert f"parquet.`{path}`" in scoring_sql(table_chain, "{book}")
    spark.read.parquet(path).createOrReplaceTempView("bucket_bands")
    for names in (None, {path: "bucket_bands"}):
        text = scoring_sql(table_chain, "{book}", category_tables=names)
        found = spark.sql(text, book=book).select("id", "segment")
        assert found.exceptAll(wanted).count() == 0 and found.count() == wanted.count()
    with pytest.raises(ValueError, match="no table named"):
        scoring_sql(table_chain, "book", quote='"')
    assert '"bucket_bands"' in scoring_sql(table_chain, "book", quote='"', category_tables={path: '"bucket_bands"'})


def test_category_table_with_disabled_bands_and_in_reports(book, chain, table_chain):
    listed, table = chain[2], table_chain[2]
    off = frozenset({listed.bands[0].id})
    listed = Step(listed.variable, listed.bands, listed.grid, off)
    table = Step(table.variable, table.bands, table.grid, off, table.categories_path)
    wanted = score(book, [*chain[:2], listed])
    found = score(book, [*chain[:2], table])
    assert found.filter("segment is null").count() > 0
    assert found.select("id", "segment").exceptAll(wanted.select("id", "segment")).count() == 0
    reports = [cell_table(book, [*chain[:2], s], SEGMENTS, [M.volume("n")]) for s in (listed, table)]
    assert sorted(map(str, reports[0].collect())) == sorted(map(str, reports[1].collect()))
    with pytest.raises(ValueError, match="with_band"):
        table.band()


def test_more_categories_than_can_be_listed(spark, tmp_path):
    rows = spark.range(500).selectExpr(
        "cast(id as int) as id", "concat('c', id % 100) as c", "double(id % 100 < 30) as bad", "1.0D as bal",
    )
    rows = rows.unionByName(spark.createDataFrame([(500, None, 1.0, 1.0), (501, "", 0.0, 1.0)], rows.schema))
    with pytest.raises(ValueError, match="categories"):
        root_step(rows, "c", SEGMENTS, LOSS)
    root = root_step(rows, "c", SEGMENTS, LOSS, categories_folder=str(tmp_path / "root"))
    got = {r["segment"]: r["count"] for r in score(rows, [root]).groupBy("segment").count().collect()}
    assert got == {0: 351, 2: 150, None: 1}  # the null category stays unassigned, the empty text is one

    even = root_step(rows, "c", SEGMENTS, categories_folder=str(tmp_path / "even"))
    sizes = spark.read.parquet(even.categories_path).groupBy("band_id").count()
    assert sorted(r["count"] for r in sizes.collect()) == [33, 34, 34]

    child = child_step(rows, [root], "c", SEGMENTS, categories_folder=str(tmp_path / "child"))
    assert score(rows, [root, child]).filter("not segment_1 <=> segment and c is not null").count() == 0
    assert score(rows.limit(0), [root, child]).count() == 0
    same = score(rows.withColumnRenamed("bal", "band_id").withColumn("category", F.lit(1)), [root])
    assert same.filter("segment = 0").count() == 351


def test_category_table_scores_a_stream(spark, book, table_chain, tmp_path):
    path = str(tmp_path / "rows")
    book.write.parquet(path)
    stream = score(spark.readStream.schema(book.schema).parquet(path), table_chain)
    query = stream.select("id", "segment").writeStream.format("memory").queryName("by_table").start()
    query.processAllAvailable()
    query.stop()
    wanted = score(book, table_chain).select("id", "segment")
    assert spark.table("by_table").exceptAll(wanted).count() == 0


def test_tables_too_long_for_configuration_are_refused(spark):
    rows = spark.range(11).selectExpr("cast(id as int) as band_id", "0 as parent_id", "1 as target_id")
    assert len(bounded_rows(rows, 11)) == 11
    with pytest.raises(ValueError, match="more than 10 rows"):
        bounded_rows(rows, 10)
    with pytest.raises(ValueError, match="more than 100000 rows"):
        collect_grid(spark.range(100_001).selectExpr("cast(id as int) as band_id", "0 as parent_id", "1 as target_id"))
