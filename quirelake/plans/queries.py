"""All queries of the library and their SQL."""

from __future__ import annotations

from quirelake.plans import layout_queries, matching_queries, stream_queries

_PARTS = [layout_queries, matching_queries, stream_queries]

QUERIES = {k: f for p in _PARTS for k, f in p.Q.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
