"""Approximate search over token sequences on Spark DataFrames."""
