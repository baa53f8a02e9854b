"""Operators: DataFrames or columns in, DataFrames out."""
