"""Operators that prepare training text, each on plain DataFrames of documents."""
