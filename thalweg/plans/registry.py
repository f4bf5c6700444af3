"""All registered queries of the library and their SQL."""

from __future__ import annotations

from thalweg.plans import more_queries, network_queries, place_queries, shape_queries, table_queries

_MODULES = [network_queries, table_queries, more_queries, place_queries, shape_queries]

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
