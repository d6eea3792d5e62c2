"""Retrieval, ranking, evaluation and statistics as Spark plans."""
