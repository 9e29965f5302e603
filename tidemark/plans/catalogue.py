"""Imports every module that registers queries."""

from tidemark.plans import join_queries, scalar_queries, stream_queries, table_queries

LOADED = (scalar_queries, join_queries, table_queries, stream_queries)
