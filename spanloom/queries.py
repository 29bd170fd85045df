"""All queries of the annotation engine by name, and their DuckDB statements."""

from __future__ import annotations

from spanloom.plans import annotation_queries, evaluation_queries, label_queries, text_queries, thread_queries, training_queries

FLAGSHIP = "modification_score"
_MODULES = (thread_queries, annotation_queries, text_queries, evaluation_queries, label_queries, training_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
