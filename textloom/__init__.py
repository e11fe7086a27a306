"""Ordered-text analytics on Spark DataFrames."""
