"""The chain used by the report queries, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from bandwise.operators.bands import Band, quantile_bands
from bandwise.operators.segments import INF, Segment
from bandwise.plans.chain import Chain, Step
from catalog.data import LOANS

SEGMENTS = [
    Segment(0, "low", 0.0, 0.01, 1.3, 1.2),
    Segment(1, "mid", 0.01, 0.02, 1.1, 1.0),
    Segment(2, "high", 0.02, 0.03, 0.9, 0.8),
    Segment(3, "top", 0.03, INF, 0.5, 0.6),
]

_CHILD = (Band(0, -1, 3), Band(1, 3, 6), Band(2, 6, 10))
_GRID = {(b, p): min(max(p + b - 1, 0), 3) for b in range(3) for p in range(4)}


def quantity_step(rows: DataFrame) -> Step:
    """Root: four quantile bands of the quantity."""
    return Step("l_quantity", tuple(quantile_bands(rows, "l_quantity", 4)))


def two_step_chain(rows: DataFrame) -> Chain:
    """Refined by discount: small ones move a row one segment up, large ones down."""
    return [quantity_step(rows), Step("discount_pct", _CHILD, _GRID)]


SCORED = (
    LOANS
    + """, cuts AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM loans),
  rooted AS (
    SELECT *, CASE WHEN l_quantity <= q[1] THEN 0 WHEN l_quantity <= q[2] THEN 1
                   WHEN l_quantity <= q[3] THEN 2 ELSE 3 END AS parent,
      CASE WHEN discount_pct <= 3 THEN 0 WHEN discount_pct <= 6 THEN 1 ELSE 2 END AS band
    FROM loans, cuts),
  scored AS (SELECT *, least(greatest(parent + band - 1, 0), 3) AS segment FROM rooted),
  segs(id, name, lower_rate, upper_rate, maf_d, maf_u) AS (VALUES (0, 'low', 0.0::DOUBLE, 0.01::DOUBLE, 1.3::DOUBLE, 1.2::DOUBLE),
    (1, 'mid', 0.01, 0.02, 1.1, 1.0), (2, 'high', 0.02, 0.03, 0.9, 0.8), (3, 'top', 0.03, 'inf'::DOUBLE, 0.5, 0.6))"""
)
