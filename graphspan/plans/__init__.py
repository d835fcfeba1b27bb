"""All queries but those of the training-data operators, and their SQL."""

from __future__ import annotations

from . import graph_queries, product_queries, session_queries, stream_queries, text_queries, verify_queries

MODULES = [graph_queries, product_queries, session_queries, text_queries, verify_queries, stream_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
