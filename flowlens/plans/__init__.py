"""Composed jobs: corpora, training recipes, scoring and the query catalogue."""
