"""Lazy queries that compile to DataFrames."""
