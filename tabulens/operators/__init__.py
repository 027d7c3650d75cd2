"""Profiling operators: DataFrames in, small DataFrames out."""
