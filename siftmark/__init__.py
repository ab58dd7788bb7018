"""Corpus scanning and compliance analytics as Spark jobs."""
