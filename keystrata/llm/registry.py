"""All queries of this package and their SQL."""

from keystrata.llm import free_queries, native_queries

QUERIES = {**free_queries.QUERIES, **native_queries.QUERIES}
ORACLES = {**free_queries.ORACLES, **native_queries.ORACLES}
