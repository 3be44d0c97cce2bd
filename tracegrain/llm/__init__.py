"""Operators of a training-data pipeline; nothing outside this package and `corpus_pipeline.py` imports it."""
