"""Registered queries and their SQL."""

from __future__ import annotations

from gridwright.plans import change_queries, graph_queries, layer_queries, layers_queries, output_queries, trace_queries

MODULES = [layer_queries, graph_queries, change_queries, trace_queries, layers_queries, output_queries]
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict = {k: v for m in MODULES for k, v in m.SQL.items()}
