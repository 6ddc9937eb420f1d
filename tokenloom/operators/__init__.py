"""Operators over DataFrames: points, index, search, clustering, evaluation."""
