"""Structured Streaming forms of the incremental array operations."""
