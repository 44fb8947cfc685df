"""Operators over DataFrames: quality flags, joins, aggregates, decompositions."""
