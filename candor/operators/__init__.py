"""Operators of truth discovery, each a function of DataFrames."""
