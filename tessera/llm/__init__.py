"""Operators for large training-text corpora, with their queries and SQL."""
