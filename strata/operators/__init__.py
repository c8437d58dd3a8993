"""Operators: each takes DataFrames and gives DataFrames."""
