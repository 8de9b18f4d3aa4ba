"""Scope-isolated knowledge analytics over DataFrames."""
