"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from . import catalog_queries, layout_queries, ledger_queries, metadata_queries, text_queries, vector_queries  # noqa: F401
from .registry import all_queries, all_sql  # noqa: F401
