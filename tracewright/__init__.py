"""Spark-first analytics over agent traces, code patches and text corpora."""
