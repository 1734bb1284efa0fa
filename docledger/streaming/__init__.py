"""Structured Streaming twins of the batch steps."""
