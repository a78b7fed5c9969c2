"""All registered queries of the route analytics and their SQL."""

from __future__ import annotations

from .plans import area_queries, measure_queries, network_queries, planning_queries, region_queries, route_queries, sampling_queries, site_queries  # noqa: F401  (all register in one catalogue)

QUERIES: dict = route_queries.QUERIES
SQL: dict[str, str] = route_queries.SQL
