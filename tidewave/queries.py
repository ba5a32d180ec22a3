"""Registered queries of the signal operators and their SQL twins."""

from __future__ import annotations

from tidewave.plans import basic_queries, derived_queries, kernel_queries, periodic_queries, stream_queries, voice_queries

_MODULES = (basic_queries, derived_queries, stream_queries, kernel_queries, voice_queries, periodic_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
