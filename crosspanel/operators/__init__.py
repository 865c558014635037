"""Operators on panels and signal tables: DataFrames in, DataFrames out."""
