"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from . import app_queries, branch_queries, data_queries, flow_queries, ingest_queries, record_queries, retrieval_queries, store_queries, text_queries

MODULES = [text_queries, retrieval_queries, data_queries, flow_queries, record_queries, app_queries, ingest_queries, branch_queries, store_queries]
QUERIES = {k: v for m in MODULES for k, v in m.R.queries.items()}
ORACLES = {k: v for m in MODULES for k, v in m.R.oracles.items()}
