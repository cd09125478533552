"""All catalog queries and their SQL."""

from __future__ import annotations

from ledgerline.plans import audit_queries, grid_queries, record_queries, series_queries, text_queries

_MODULES = (audit_queries, text_queries, series_queries, grid_queries, record_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
