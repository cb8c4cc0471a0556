"""Granthika: a Spark engine that cleans, measures and assembles text corpora."""
