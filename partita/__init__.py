"""Spark jobs that cluster categorical tables, explain the clusters, and prepare text corpora."""
