"""The named queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from cadenza.plans import combine_queries, media_queries, payload_queries, reindex_queries, sql_queries, stream_queries, time_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (reindex_queries, combine_queries, payload_queries, media_queries, time_queries, stream_queries, sql_queries):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
