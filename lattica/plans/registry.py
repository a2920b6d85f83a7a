"""All queries of the library proper, by name, and their SQL."""

from __future__ import annotations

from lattica.plans import geometry_queries, more_queries, other_queries, volume_queries

QUERIES = geometry_queries.QUERIES | volume_queries.QUERIES | other_queries.QUERIES | more_queries.QUERIES
ORACLES = geometry_queries.ORACLES | volume_queries.ORACLES | other_queries.ORACLES | more_queries.ORACLES
