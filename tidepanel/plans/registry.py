"""All registered queries of the library with their SQL."""

from __future__ import annotations

from . import context_queries, corpus_queries, model_queries, panel_queries, product_queries, stream_queries, table_queries  # noqa: F401 (product_queries adds to panel_queries' tables)

QUERIES: dict = panel_queries.QUERIES | table_queries.QUERIES | corpus_queries.QUERIES | stream_queries.QUERIES | model_queries.QUERIES | context_queries.QUERIES
ORACLE: dict = panel_queries.ORACLE | table_queries.ORACLE | corpus_queries.ORACLE | stream_queries.ORACLE | model_queries.ORACLE | context_queries.ORACLE
