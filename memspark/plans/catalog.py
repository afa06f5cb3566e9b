"""All registered queries over the reference's own operators, and their SQL."""

from memspark.plans import queries_analytics, queries_ingest, queries_live, queries_memory, queries_search

QUERIES = {}
ORACLE_SQL = {}
for module in (queries_ingest, queries_search, queries_analytics, queries_memory, queries_live):
    QUERIES |= module.Q
    ORACLE_SQL |= module.S
