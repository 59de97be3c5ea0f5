"""Structured Streaming entry points (the reference has no streaming; the
row-local operators are reused unchanged on streaming DataFrames)."""
