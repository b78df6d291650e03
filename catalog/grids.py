"""Second variables: bands within parents, grids, their merging and description."""

from dataclasses import replace

from pyspark.sql import functions as F

from bandwise.operators.bands import (
    assign,
    assign_lookup,
    bands_frame,
    collect_bands,
    collect_categories,
    describe_categories,
    even_category_bands,
)
from bandwise.operators.grid import (
    assign_grid,
    assign_targets,
    collect_grid,
    describe_grid,
    grid_frame,
    identity_grid,
    join_grid,
    merge_equal_bands,
    merge_equal_categories,
    monotone_grid,
)
from bandwise.operators.loss_bands import (
    LossRate,
    ValueTable,
    grid_bands,
    loss_rate_categories,
    table_bands,
)
from bandwise.operators.segments import INF, segment_frame
from bandwise.plans.build import child_step, root_step
from bandwise.plans.chain import score, scoring_sql
from catalog.chains import SCORED, SEGMENTS, quantity_step, two_step_chain
from catalog.data import LOANS, loans, rounded, shared_folder
from catalog.registry import query

_LOSS = LossRate("loss", "balance", use_scalar=False)


def _with_parent(rows):
    """Loans with the segment of the root variable as parent."""
    return score(rows, [quantity_step(rows)]).withColumnRenamed("segment", "parent_id")


def _child_bands(rows):
    return grid_bands(rows, "discount_pct", "parent_id", SEGMENTS, _LOSS, 1, 1, high_is_risky=True)


def _cells(rows, bands):
    return (
        rows.withColumn("band_id", assign(F.col("discount_pct"), bands))
        .groupBy("band_id", "parent_id")
        .agg((F.sum("loss") / F.sum("balance")).alias("rate"))
    )


def _targets(rows, bands):
    return assign_targets(_cells(rows, bands), bands_frame(rows.sparkSession, bands), SEGMENTS, _LOSS, 1, 1)


def _found_grid(rows, bands):
    """The grid as a table of its own: bands x segments rows, so merging it rescans nothing."""
    return grid_frame(rows.sparkSession, collect_grid(_targets(rows, bands)))


# Greedy banding within each parent (segments within one step), then all cut points together.
_BANDS_SQL = (
    SCORED.replace("scored AS (SELECT *, least(greatest(parent + band - 1, 0), 3) AS segment FROM rooted),", "")
    + """,
    lim AS (SELECT p.id AS parent, s.id AS k, CASE WHEN isinf(s.upper_rate) THEN 1e308 ELSE s.upper_rate END AS t
            FROM segs p JOIN segs s ON abs(s.id - p.id) <= 1),
    rates AS (SELECT parent, discount_pct::DOUBLE AS v, sum(loss) / sum(balance) AS r FROM rooted GROUP BY 1, 2),
    took AS (SELECT parent, v, coalesce((SELECT min(k) FROM lim WHERE lim.parent = rates.parent AND r < t), 99) AS k FROM rates),
    walk AS (SELECT parent, v, max(k) OVER (PARTITION BY parent ORDER BY v) AS s FROM took),
    edge AS (SELECT parent, min(v) - 1 AS low, max(v) AS high FROM rates GROUP BY 1),
    points AS (
      SELECT low AS x FROM edge UNION SELECT high FROM edge
      UNION SELECT coalesce((SELECT max(v) FROM walk WHERE walk.parent = lim.parent AND s <= lim.k), edge.low)
      FROM lim JOIN edge USING (parent) WHERE lim.k < least(lim.parent + 1, 3)),
    pairs AS (SELECT x AS lower, lead(x) OVER (ORDER BY x) AS upper FROM points),
    bands AS (SELECT CAST(row_number() OVER (ORDER BY lower) - 1 AS INT) AS band_id, lower, upper FROM pairs WHERE upper IS NOT NULL),
    cells AS (SELECT band_id, parent AS parent_id, sum(loss) / sum(balance) AS rate FROM rooted
              JOIN bands ON discount_pct > lower AND discount_pct <= upper GROUP BY 1, 2),
    grid AS (
      SELECT b.band_id, p.id AS parent_id,
        CASE WHEN c.rate IS NULL THEN p.id
             ELSE coalesce((SELECT min(s.id) FROM segs s WHERE abs(s.id - p.id) <= 1 AND c.rate < s.upper_rate),
                           least(p.id + 1, 3)) END AS target_id
      FROM bands b CROSS JOIN segs p LEFT JOIN cells c ON c.band_id = b.band_id AND c.parent_id = p.id),
    sig AS (SELECT band_id, string_agg(target_id, ',' ORDER BY parent_id) AS targets FROM grid GROUP BY 1),
    isles AS (SELECT band_id, CAST(sum(fresh) OVER (ORDER BY band_id) - 1 AS INT) AS new_id FROM (
      SELECT band_id, CASE WHEN targets = lag(targets) OVER (ORDER BY band_id) THEN 0 ELSE 1 END AS fresh FROM sig)),
    merged AS (SELECT new_id AS band_id, min(lower) AS lower, max(upper) AS upper FROM isles JOIN bands USING (band_id) GROUP BY 1),
    merged_grid AS (SELECT DISTINCT new_id AS band_id, parent_id, target_id FROM isles JOIN grid USING (band_id))
    """
)


@query(f"WITH {_BANDS_SQL} SELECT * FROM bands")
def bands_within_parents(spark, sf_dir):
    return bands_frame(spark, _child_bands(_with_parent(loans(spark, sf_dir))))


@query(
    f"""
    WITH {_BANDS_SQL} SELECT band_id, parent_id, round(rate, 8) AS rate FROM cells
    """
)
def loss_rates_of_cells(spark, sf_dir):
    rows = _with_parent(loans(spark, sf_dir))
    return _cells(rows, _child_bands(rows)).withColumn("rate", rounded("rate", 8))


@query(f"WITH {_BANDS_SQL} SELECT * FROM grid")
def targets_of_cells(spark, sf_dir):
    rows = _with_parent(loans(spark, sf_dir))
    return _targets(rows, _child_bands(rows))


@query(f"WITH {_BANDS_SQL} SELECT band_id, lower, upper, target_id, parent_id FROM merged JOIN merged_grid USING (band_id)")
def neighbouring_bands_merged(spark, sf_dir):
    rows = _with_parent(loans(spark, sf_dir))
    bands = _child_bands(rows)
    merged, grid = merge_equal_bands(bands_frame(spark, bands), _found_grid(rows, bands))
    return merged.join(grid, "band_id")


@query(
    f"""
    WITH {_BANDS_SQL},
    r AS (SELECT band_id, parent_id, max(target_id) OVER (PARTITION BY band_id ORDER BY parent_id) AS t FROM merged_grid)
    SELECT band_id, parent_id, max(t) OVER (PARTITION BY parent_id ORDER BY band_id) AS target_id FROM r
    """
)
def grid_made_monotone(spark, sf_dir):
    rows = _with_parent(loans(spark, sf_dir))
    bands = _child_bands(rows)
    _, grid = merge_equal_bands(bands_frame(spark, bands), _found_grid(rows, bands))
    return monotone_grid(grid)


@query(
    f"""
    WITH {_BANDS_SQL}, f AS (
      SELECT target_id, loss, balance FROM rooted
      LEFT JOIN merged ON discount_pct > lower AND discount_pct <= upper
      LEFT JOIN merged_grid g ON g.band_id = merged.band_id AND g.parent_id = parent)
    SELECT target_id AS segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate FROM f GROUP BY 1
    """
)
def rows_scored_by_found_grid(spark, sf_dir):
    """Bands, targets and merging end to end, then every row scored."""
    rows = _with_parent(loans(spark, sf_dir))
    bands = _child_bands(rows)
    merged, grid = merge_equal_bands(bands_frame(spark, bands), _found_grid(rows, bands))
    segment = assign_grid(
        F.col("discount_pct"), F.col("parent_id"), collect_bands(merged), collect_grid(grid)
    )
    return rows.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("loss") / F.sum("balance"), 8).alias("rate")
    )


_CATEGORY_SQL = (
    SCORED
    + """,
    cats AS (SELECT CAST(row_number() OVER (ORDER BY c) - 1 AS INT) AS band_id, c FROM (SELECT DISTINCT CAST(discount_pct AS VARCHAR) AS c FROM loans)),
    cells AS (SELECT band_id, parent AS parent_id, sum(loss) / sum(balance) AS rate FROM rooted
              JOIN cats ON CAST(discount_pct AS VARCHAR) = c GROUP BY 1, 2),
    grid AS (
      SELECT b.band_id, p.id AS parent_id,
        CASE WHEN c.rate IS NULL THEN p.id
             ELSE coalesce((SELECT min(s.id) FROM segs s WHERE abs(s.id - p.id) <= 1 AND c.rate < s.upper_rate),
                           least(p.id + 1, 3)) END AS target_id
      FROM cats b CROSS JOIN segs p LEFT JOIN cells c ON c.band_id = b.band_id AND c.parent_id = p.id),
    sig AS (SELECT band_id, list(target_id ORDER BY parent_id) AS targets FROM grid GROUP BY 1),
    renum AS (SELECT band_id, CAST(dense_rank() OVER (ORDER BY targets) - 1 AS INT) AS new_id FROM sig)
    """
)


def _category_grid(spark, sf_dir):
    rows = _with_parent(loans(spark, sf_dir)).withColumn("text", F.col("discount_pct").cast("string"))
    categories = even_category_bands(rows, "text", 11)
    cells = (
        assign_lookup(rows, "text", categories, "band_id")
        .groupBy("band_id", "parent_id")
        .agg((F.sum("loss") / F.sum("balance")).alias("rate"))
    )
    bands = categories.select("band_id").distinct()
    grid = assign_targets(cells, bands, SEGMENTS, _LOSS, 1, 1)
    return categories, grid_frame(spark, collect_grid(grid))


@query(
    f"WITH {_CATEGORY_SQL} SELECT new_id AS band_id, c AS category FROM renum JOIN cats USING (band_id)"
)
def equal_category_bands_merged(spark, sf_dir):
    merged, _ = merge_equal_categories(*_category_grid(spark, sf_dir))
    return merged


@query(
    f"""WITH {_CATEGORY_SQL} SELECT DISTINCT new_id AS band_id, parent_id, target_id
    FROM renum JOIN grid USING (band_id)"""
)
def grid_of_merged_categories(spark, sf_dir):
    _, grid = merge_equal_categories(*_category_grid(spark, sf_dir))
    return grid


@query(
    f"""
    WITH {LOANS}, r AS (SELECT l_returnflag AS c, sum(loss) / sum(balance) AS rate FROM loans GROUP BY 1),
    b AS (SELECT c, CASE WHEN rate < 0.01 THEN 0 WHEN rate < 0.02 THEN 1 WHEN rate < 0.03 THEN 2 ELSE 3 END AS band_id FROM r)
    SELECT band_id, string_agg(c, ', ' ORDER BY c) AS categories FROM b GROUP BY 1
    """
)
def category_bands_described(spark, sf_dir):
    found = collect_categories(loss_rate_categories(loans(spark, sf_dir), "l_returnflag", SEGMENTS, _LOSS))
    return spark.createDataFrame(list(describe_categories(found).items()), "band_id int, categories string")


@query(
    f"""
    WITH {SCORED}
    SELECT b.band AS band_id, s.id AS parent_id, s.id AS target_id
    FROM (SELECT DISTINCT band FROM rooted) b CROSS JOIN segs s
    """
)
def grid_without_changes(spark, sf_dir):
    rows = loans(spark, sf_dir)
    bands = rows.select(two_step_chain(rows)[1].band().alias("band_id")).distinct()
    return identity_grid(bands, segment_frame(spark, SEGMENTS))


_GRID_SUMMARY = f"""
    WITH {SCORED}
    SELECT band, parent, CASE WHEN band <> 1 THEN segment END AS segment, count(*) AS n
    FROM scored GROUP BY ALL
    """


@query(_GRID_SUMMARY)
def grid_assigned(spark, sf_dir):
    """A literal lookup; the middle band is switched off."""
    rows = loans(spark, sf_dir)
    step = two_step_chain(rows)[1]
    scored = _with_parent(rows).select(
        step.band().alias("band"),
        F.col("parent_id").alias("parent"),
        assign_grid(F.col("discount_pct"), F.col("parent_id"), step.bands, step.grid, {1}).alias("segment"),
    )
    return scored.groupBy("band", "parent", "segment").agg(F.count(F.lit(1)).alias("n"))


@query(_GRID_SUMMARY)
def grid_joined(spark, sf_dir):
    """The same as a left join with the grid table."""
    rows = loans(spark, sf_dir)
    step = two_step_chain(rows)[1]
    cells = [(b, p, t) for (b, p), t in step.grid.items() if b != 1]
    table = spark.createDataFrame(cells, "band_id int, parent_id int, target_id int")
    placed = _with_parent(rows).withColumn("band", step.band())
    joined = join_grid(placed, "band", "parent_id", table, "segment")
    return joined.groupBy("band", F.col("parent_id").alias("parent"), "segment").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    f"""
    WITH {_BANDS_SQL}, n AS (SELECT g.band_id, p.name AS parent, s.name AS target FROM merged_grid g
      JOIN segs p ON p.id = parent_id JOIN segs s ON s.id = target_id WHERE g.band_id <> 0)
    SELECT band_id, max(CASE WHEN parent = 'low' THEN target END) AS low, max(CASE WHEN parent = 'mid' THEN target END) AS mid,
      max(CASE WHEN parent = 'high' THEN target END) AS high, max(CASE WHEN parent = 'top' THEN target END) AS top
    FROM n GROUP BY 1
    """
)
def grid_described(spark, sf_dir):
    """Segment names; the first band is switched off and left out."""
    rows = _with_parent(loans(spark, sf_dir))
    bands = _child_bands(rows)
    _, grid = merge_equal_bands(bands_frame(spark, bands), _found_grid(rows, bands))
    return describe_grid(grid, SEGMENTS, {0})



@query(
    f"""
    WITH {_BANDS_SQL}, f AS (
      SELECT target_id, loss, balance FROM rooted
      LEFT JOIN merged ON discount_pct > lower AND discount_pct <= upper
      LEFT JOIN merged_grid g ON g.band_id = merged.band_id AND g.parent_id = parent)
    SELECT target_id AS segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate FROM f GROUP BY 1
    """
)
def chain_built_and_scored(spark, sf_dir):
    """A two-step chain built from the data by the library, then applied."""
    rows = loans(spark, sf_dir)
    root = root_step(rows, "l_quantity", SEGMENTS)
    child = child_step(
        rows, [root], "discount_pct", SEGMENTS, _LOSS, upgrade=1, downgrade=1, high_is_risky=True
    )
    return score(rows, [root, child]).groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("loss") / F.sum("balance"), 8).alias("rate")
    )


# Limits around the overall loss rate, at which bands merge, targets reach their limits and cells change.
_NEAR = [replace(s, upper_rate=u) for s, u in zip(SEGMENTS, (0.0155, 0.0165, 0.018, INF))]
_SCALED = [replace(s, upper_rate=u) for s, u in zip(SEGMENTS, (0.0161, 0.0166, 0.017, INF))]


def _near_sql(column: str, segments, loss: LossRate, reach: int, rising: bool) -> str:
    """Greedy bands within each parent, cell rates, targets and merging; segments and scaling as given."""
    rows = ", ".join(
        f"({s.id}, {s.upper_rate if s.upper_rate < INF else 1e308}::DOUBLE, {loss.factor(s)!r}::DOUBLE)" for s in segments
    )
    kept, beyond = ("max(v)", "edge.low") if rising else ("min(v) - 1", "edge.high")
    order, numbered = ("v", "lower") if rising else ("v DESC", "lower DESC")
    last = len(segments) - 1
    head = SCORED.replace("scored AS (SELECT *, least(greatest(parent + band - 1, 0), 3) AS segment FROM rooted),", "")
    return head + f""",
    near(id, upper_rate, factor) AS (VALUES {rows}),
    lim AS (SELECT p.id AS parent, s.id AS k, max(s.upper_rate / s.factor) OVER (PARTITION BY p.id ORDER BY s.id) AS t
            FROM near p JOIN near s ON abs(s.id - p.id) <= {reach}),
    rates AS (SELECT parent, {column}::DOUBLE AS v, sum(loss) / sum(balance) AS r FROM rooted GROUP BY 1, 2),
    took AS (SELECT parent, v, coalesce((SELECT min(k) FROM lim WHERE lim.parent = rates.parent AND r < t), 99) AS k FROM rates),
    walk AS (SELECT parent, v, max(k) OVER (PARTITION BY parent ORDER BY {order}) AS s FROM took),
    edge AS (SELECT parent, min(v) - 1 AS low, max(v) AS high FROM rates GROUP BY 1),
    points AS (
      SELECT low AS x FROM edge UNION SELECT high FROM edge
      UNION SELECT coalesce((SELECT {kept} FROM walk WHERE walk.parent = lim.parent AND s <= lim.k), {beyond})
      FROM lim JOIN edge USING (parent) WHERE lim.k < least(lim.parent + {reach}, {last})),
    pairs AS (SELECT x AS lower, lead(x) OVER (ORDER BY x) AS upper FROM points),
    bands AS (SELECT CAST(row_number() OVER (ORDER BY {numbered}) - 1 AS INT) AS band_id, lower, upper FROM pairs WHERE upper IS NOT NULL),
    cells AS (SELECT band_id, parent AS parent_id, sum(loss) / sum(balance) AS rate FROM rooted
              JOIN bands ON {column} > lower AND {column} <= upper GROUP BY 1, 2),
    grid AS (
      SELECT b.band_id, p.id AS parent_id,
        CASE WHEN c.rate IS NULL THEN p.id
             ELSE coalesce((SELECT min(s.id) FROM near s WHERE abs(s.id - p.id) <= {reach} AND c.rate * greatest(s.factor, 1) < s.upper_rate),
                           least(p.id + {reach}, {last})) END AS target_id
      FROM bands b CROSS JOIN near p LEFT JOIN cells c ON c.band_id = b.band_id AND c.parent_id = p.id),
    sig AS (SELECT band_id, string_agg(target_id, ',' ORDER BY parent_id) AS targets FROM grid GROUP BY 1),
    isles AS (SELECT band_id, CAST(sum(fresh) OVER (ORDER BY band_id) - 1 AS INT) AS new_id FROM (
      SELECT band_id, CASE WHEN targets = lag(targets) OVER (ORDER BY band_id) THEN 0 ELSE 1 END AS fresh FROM sig)),
    merged AS (SELECT new_id AS band_id, min(lower) AS lower, max(upper) AS upper FROM isles JOIN bands USING (band_id) GROUP BY 1),
    merged_grid AS (SELECT DISTINCT new_id AS band_id, parent_id, target_id FROM isles JOIN grid USING (band_id)),
    swept AS (SELECT band_id, parent_id, max(target_id) OVER (PARTITION BY band_id ORDER BY parent_id) AS t FROM merged_grid),
    monotone AS (SELECT band_id, parent_id, max(t) OVER (PARTITION BY parent_id ORDER BY band_id) AS target_id FROM swept)
    """


_SCALE = LossRate("loss", "balance", scalar=0.8)


def found_bands(rows, column, segments, loss, reach, rising):
    """Bands of a column within parents and the targets of their cells, from one table of values."""
    with ValueTable(rows, column, loss, ["parent_id"]) as table:
        bands = table_bands(table, segments, reach, reach, high_is_risky=rising)
        cells = table.cell_rates(bands).collect()
    cells = rows.sparkSession.createDataFrame(cells, "band_id int, parent_id int, rate double")
    return bands, assign_targets(cells, bands_frame(rows.sparkSession, bands), segments, loss, reach, reach)


@query(
    f"""WITH {_near_sql("tax_pct", _NEAR, _LOSS, 2, False)}
    SELECT band_id, lower, upper, parent_id, target_id FROM merged JOIN merged_grid USING (band_id)"""
)
def falling_bands_merged(spark, sf_dir):
    """Low values are the risky ones; two neighbouring bands have the same targets and become one."""
    rows = _with_parent(loans(spark, sf_dir))
    bands, targets = found_bands(rows, "tax_pct", _NEAR, _LOSS, 2, False)
    merged, grid = merge_equal_bands(bands_frame(spark, bands), grid_frame(spark, collect_grid(targets)))
    return merged.join(grid, "band_id")


@query(f'WITH {_near_sql("tax_pct", _NEAR, _LOSS, 2, False)} SELECT band_id, parent_id, target_id FROM monotone')
def falling_grid_made_monotone(spark, sf_dir):
    """The same grid with the cells raised that were better than one to their left or above."""
    rows = _with_parent(loans(spark, sf_dir))
    bands, targets = found_bands(rows, "tax_pct", _NEAR, _LOSS, 2, False)
    _, grid = merge_equal_bands(bands_frame(spark, bands), grid_frame(spark, collect_grid(targets)))
    return monotone_grid(grid)


@query(f'WITH {_near_sql("tax_pct", _SCALED, _SCALE, 1, True)} SELECT band_id, parent_id, target_id FROM grid')
def targets_under_scaled_limits(spark, sf_dir):
    """Bands use each segment's scale factor as it is, targets one of at least 1."""
    rows = _with_parent(loans(spark, sf_dir))
    return found_bands(rows, "tax_pct", _SCALED, _SCALE, 1, True)[1]


@query(
    f"""
    WITH {_near_sql("tax_pct", _NEAR, _LOSS, 2, False)}, f AS (
      SELECT target_id, loss, balance FROM rooted
      LEFT JOIN merged ON tax_pct > lower AND tax_pct <= upper
      LEFT JOIN monotone g ON g.band_id = merged.band_id AND g.parent_id = parent)
    SELECT target_id AS segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate FROM f GROUP BY 1
    """
)
def monotone_chain_built_and_scored(spark, sf_dir):
    """A chain with a falling variable and a monotone grid, built by the library, then applied."""
    rows = loans(spark, sf_dir)
    root = root_step(rows, "l_quantity", _NEAR)
    child = child_step(
        rows, [root], "tax_pct", _NEAR, _LOSS, upgrade=2, downgrade=2, monotone=True, high_is_risky=False
    )
    return _summed(score(rows, [root, child]))


def _summed(scored):
    return scored.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.sum("loss") / F.sum("balance"), 8).alias("rate")
    )


@query(
    f"""
    WITH {_near_sql("tax_pct", _NEAR, _LOSS, 2, False)},
    second AS (
      SELECT rooted.*, target_id AS parent2 FROM rooted JOIN merged ON tax_pct > lower AND tax_pct <= upper
      JOIN merged_grid g ON g.band_id = merged.band_id AND g.parent_id = parent),
    modes AS (SELECT l_linenumber AS line, sum(loss) / sum(balance) AS r FROM second GROUP BY 1),
    cats AS (SELECT line, coalesce((SELECT min(id) FROM near WHERE r < upper_rate), 3) AS cat FROM modes),
    third AS (SELECT second.*, cat FROM second JOIN cats ON line = l_linenumber),
    cells3 AS (SELECT cat, parent2, sum(loss) / sum(balance) AS rate FROM third GROUP BY 1, 2),
    grid3 AS (SELECT cat, parent2, coalesce((SELECT min(s.id) FROM near s WHERE abs(s.id - parent2) <= 1 AND rate < s.upper_rate),
                least(parent2 + 1, 3)) AS target3 FROM cells3)
    SELECT target3 AS segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate FROM third JOIN grid3 USING (cat, parent2) GROUP BY 1
    """
)
def three_step_chain_built_and_scored(spark, sf_dir):
    """Quantity, then tax within it, then line numbers as categories within both."""
    rows = loans(spark, sf_dir).withColumn("line", F.col("l_linenumber").cast("string"))
    root = root_step(rows, "l_quantity", _NEAR)
    child = child_step(rows, [root], "tax_pct", _NEAR, _LOSS, upgrade=2, downgrade=2, high_is_risky=False)
    last = child_step(rows, [root, child], "line", _NEAR, _LOSS, upgrade=1, downgrade=1)
    return _summed(score(rows, [root, child, last]))


def _by_category(column: str) -> str:
    """A column's categories after quantity and tax: rates, the segments they fit, targets, and what comes out."""
    return f"""
    second AS (
      SELECT rooted.*, target_id AS parent2 FROM rooted JOIN merged ON tax_pct > lower AND tax_pct <= upper
      JOIN merged_grid g ON g.band_id = merged.band_id AND g.parent_id = parent),
    modes AS (SELECT {column} AS line, sum(loss) / sum(balance) AS r FROM second GROUP BY 1),
    cats AS (SELECT line, coalesce((SELECT min(id) FROM near WHERE r < upper_rate), 3) AS cat FROM modes),
    third AS (SELECT second.*, cat FROM second JOIN cats ON line = {column}),
    cells3 AS (SELECT cat, parent2, sum(loss) / sum(balance) AS rate FROM third GROUP BY 1, 2),
    grid3 AS (SELECT cat, parent2, coalesce((SELECT min(s.id) FROM near s WHERE abs(s.id - parent2) <= 1 AND rate < s.upper_rate),
                least(parent2 + 1, 3)) AS target3 FROM cells3)
    SELECT target3 AS segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate FROM third JOIN grid3 USING (cat, parent2) GROUP BY 1
    """


def _supplier_chain(spark, sf_dir):
    """Quantity, then tax within it, then suppliers: as many categories as there are, in a table that is joined."""
    rows = loans(spark, sf_dir).withColumn("supplier", F.concat(F.lit("s'"), F.col("l_suppkey").cast("string")))
    root = root_step(rows, "l_quantity", _NEAR)
    child = child_step(rows, [root], "tax_pct", _NEAR, _LOSS, upgrade=2, downgrade=2, high_is_risky=False)
    folder = shared_folder(spark)
    last = child_step(rows, [root, child], "supplier", _NEAR, _LOSS, upgrade=1, downgrade=1, categories_folder=folder)
    return rows, [root, child, last]


_SUPPLIERS = f'WITH {_near_sql("tax_pct", _NEAR, _LOSS, 2, False)}, {_by_category("l_suppkey")}'


@query(_SUPPLIERS)
def three_step_chain_of_many_categories(spark, sf_dir):
    """A chain whose last step holds a category table of any length, built by the library, then applied."""
    rows, chain = _supplier_chain(spark, sf_dir)
    return _summed(score(rows, chain))


@query(_SUPPLIERS)
def many_categories_scored_by_sql(spark, sf_dir):
    """The same chain as SQL text, in which the category table is a join."""
    rows, chain = _supplier_chain(spark, sf_dir)
    return _summed(spark.sql(scoring_sql(chain, "{rows}"), rows=rows))


@query(
    f"""
    WITH {LOANS},
    ranked AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS place, count(*) OVER () AS n
               FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS s FROM loans)),
    chunks AS (SELECT s, CAST(CASE WHEN place < (n % 4) * (n // 4 + 1) THEN place // (n // 4 + 1)
                 ELSE n % 4 + (place - (n % 4) * (n // 4 + 1)) // (n // 4) END AS INT) AS segment FROM ranked)
    SELECT segment, count(*) AS n, round(sum(loss) / sum(balance), 8) AS rate
    FROM loans JOIN chunks ON s = CAST(l_suppkey AS VARCHAR) GROUP BY 1
    """
)
def even_bands_of_many_categories(spark, sf_dir):
    """Suppliers in four even chunks of their sorted names, as the first step of a chain."""
    rows = loans(spark, sf_dir).withColumn("supplier", F.col("l_suppkey").cast("string"))
    root = root_step(rows, "supplier", SEGMENTS, categories_folder=shared_folder(spark))
    return _summed(score(rows, [root]))
