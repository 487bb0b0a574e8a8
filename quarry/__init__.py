"""Artifact cataloguing, filtering, deduplication and export on Spark DataFrames."""
