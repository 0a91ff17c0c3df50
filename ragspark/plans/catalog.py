"""All registered queries of the reference's operators."""

from __future__ import annotations

from ragspark.plans import corpus_queries, extension_queries, generation_queries, migration_queries, operations_queries, retrieval_queries

_PARTS = (corpus_queries, retrieval_queries, operations_queries, extension_queries, generation_queries, migration_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
