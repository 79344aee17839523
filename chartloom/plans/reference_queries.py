"""All queries of the retrieval system's own operators, with their SQL."""

from __future__ import annotations

from chartloom.plans import evaluation_queries, profile_queries, retrieval_queries

_MODULES = (profile_queries, retrieval_queries, evaluation_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: q for m in _MODULES for name, q in m.SQL.items()}
