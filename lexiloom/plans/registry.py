"""Registered queries and their DuckDB SQL."""

from __future__ import annotations

from . import evaluation_queries, score_queries, text_queries

QUERIES = {**text_queries.QUERIES, **score_queries.QUERIES, **evaluation_queries.QUERIES}
SQL = {**text_queries.SQL, **score_queries.SQL, **evaluation_queries.SQL}
