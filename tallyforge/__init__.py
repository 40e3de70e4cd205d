"""Spark-first analytics over a company graph, an input-output economy and filing text."""
