"""Clustering evaluation jobs on Spark: DataFrames in, DataFrames out."""
