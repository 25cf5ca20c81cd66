"""All core queries and their SQL counterparts."""

from __future__ import annotations

from quillgraph.plans import graph_queries, hierarchy_queries, relation_queries, search_queries, store_queries, text_queries, traversal_queries

_MODULES = [hierarchy_queries, text_queries, graph_queries, search_queries, relation_queries, store_queries, traversal_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
