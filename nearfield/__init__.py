"""Similarity search over dense vectors on Spark DataFrames."""
