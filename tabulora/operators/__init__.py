"""Operators over DataFrames of elements, passages, queries, facts and logs."""
