"""Retrieval, ranking, evaluation and operation of document corpora on Spark."""
