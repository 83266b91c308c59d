"""Retrieval analytics over DataFrames."""
