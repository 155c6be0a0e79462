"""Batch operators: DataFrames in, a DataFrame out."""
