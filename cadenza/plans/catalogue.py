"""All queries of the engine and their SQL."""

from __future__ import annotations

from cadenza.plans import feature_queries, graph_queries, network_queries, sequence_queries, source_queries, statistics_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for part in (feature_queries, statistics_queries, graph_queries, source_queries, sequence_queries, network_queries):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
