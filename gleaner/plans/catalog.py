"""All queries of the core, and the SQL that gives the same rows."""

from __future__ import annotations

from gleaner.plans import geo_queries, table_queries, text_queries

QUERIES = {"p7_found": geo_queries.p7_found} | text_queries.QUERIES | table_queries.QUERIES
ORACLE_SQL = {"p7_found": geo_queries.P7_FOUND_SQL} | text_queries.ORACLE_SQL | table_queries.ORACLE_SQL
