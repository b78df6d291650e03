"""Registered queries: each operator applied to the supplied tables, with its SQL."""

from catalog import filters, functions, grids, metrics, profiles, segmentation, sources, tables  # noqa: F401
from catalog.registry import ORACLES, QUERIES  # noqa: F401
