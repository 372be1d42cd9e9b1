"""Operators over DataFrames of sequences."""
