"""Corpus indexing, hybrid retrieval, symbol-graph analytics and evidence ranking on Spark."""
