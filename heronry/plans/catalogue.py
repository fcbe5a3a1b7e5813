"""All queries of the library by name, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from . import context_queries, curation_queries, evaluation_queries, graph_queries, listing_queries, operations_queries, ranking_queries, records_queries, review_queries, search_queries, session_queries, state_queries, stream_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
