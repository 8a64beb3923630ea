"""Corpus retrieval, grounding, revision and evaluation on PySpark DataFrames."""
