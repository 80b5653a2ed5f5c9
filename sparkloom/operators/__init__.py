"""Relational and retrieval operators: DataFrames in, DataFrames out."""
