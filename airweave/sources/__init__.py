"""Readers of raw feeds. Each returns long DataFrames; paths may be any that Spark reads."""
