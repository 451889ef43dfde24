"""Lodestack: Spark-first analytics over corpora of nested binary and text reports."""
