"""Operators of a training-data pipeline over documents, pages and vectors.

Nothing outside this package, its tests and ``corpus_pipeline.py`` imports it.
"""
