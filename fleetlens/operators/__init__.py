"""Operators: DataFrames in, DataFrames out, all scopes at once."""
