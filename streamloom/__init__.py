"""Spark-first analytics over event streams and text corpora."""
