"""Operators over evidence tables: DataFrames in, DataFrames out."""
