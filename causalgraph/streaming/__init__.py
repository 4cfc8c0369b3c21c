"""Incremental graph maintenance on Structured Streaming."""
