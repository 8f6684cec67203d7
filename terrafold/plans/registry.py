"""Registered queries with their SQL oracles, gathered from the plan modules."""

from __future__ import annotations

from . import io_queries, raster_queries, site_queries, table_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (io_queries, raster_queries, site_queries, table_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
