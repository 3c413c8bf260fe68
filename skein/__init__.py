"""Similarity search and analytics on Spark DataFrames."""
