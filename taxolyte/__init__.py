"""Batch terminology and taxonomy analytics on Spark DataFrames."""
