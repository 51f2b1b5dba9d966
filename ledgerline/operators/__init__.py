"""Operators on DataFrames, named by what they do; columns are parameters."""
