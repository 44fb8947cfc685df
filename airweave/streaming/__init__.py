"""Structured Streaming forms of the flag and resample operators."""
