"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import cut

#: Edges that a task of a step gets, if there are so many.
TASK_EDGES = 1 << 16


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("_hi", "_lo"))).first())


def _oriented(hi: str, lo: str) -> list:
    return [F.greatest(hi, lo).alias("_hi"), F.least(hi, lo).alias("_lo")]


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Every node that has an edge to another, with the smallest node it can reach: columns `node`, `component`.

    Edges with a null end and loops say nothing and are ignored; no edges give no rows. Each step attaches neighbours to
    the smallest node a neighbour knows, so even a chain of n nodes takes about log n steps. A hub is only ever an
    aggregate with partial sums, or the large side of a sort-merge join against one row a node, which adaptive
    execution splits; no list of neighbours is built, and nothing but two numbers a step reaches the driver.
    """
    edges = edges.select(F.col(left).alias("_a"), F.col(right).alias("_b")).filter("_a <> _b")
    edges = cut(edges.select(*_oriented("_a", "_b")).distinct())
    state = _state(edges)
    while state[0]:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-state[0] // TASK_EDGES))
        # Large star: what lies above a node goes to the smallest node known there.
        ends = edges.select(F.col("_lo").alias("_at"), F.col("_lo").alias("_m")).union(edges.select(F.col("_hi"), F.col("_lo")))
        least = cut(ends.groupBy("_at").agg(F.min("_m").alias("_m")).coalesce(tasks))
        edges = edges.join(least, edges["_lo"] == least["_at"]).select("_hi", F.col("_m").alias("_lo"))
        edges = cut(edges.coalesce(tasks).distinct().coalesce(tasks))
        # Small star: a node and what lies below it go to the smallest of them.
        least = cut(edges.groupBy(F.col("_hi").alias("_at")).agg(F.min("_lo").alias("_m")).coalesce(tasks))
        below = edges.join(least, edges["_hi"] == least["_at"]).filter("_lo <> _m")
        below = below.select(F.col("_lo").alias("_hi"), F.col("_m").alias("_lo")).coalesce(tasks)
        edges = cut(below.union(least).distinct().coalesce(tasks))
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("_lo").alias("node"), F.col("_lo").alias("component")).distinct()
    return edges.select(F.col("_hi").alias("node"), F.col("_lo").alias("component")).union(roots)
