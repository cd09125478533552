"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from ledgerline.llm import mixing, near_dups, neighbours, packing, quality, secrets, substrings, syncmers, token_counts, toxicity

_MODULES = (quality, near_dups, mixing, toxicity, syncmers, secrets, packing, token_counts, substrings, neighbours)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
