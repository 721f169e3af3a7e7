"""Spark jobs that import, annotate, compare and release a large text corpus."""
