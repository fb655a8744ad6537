"""Structured Streaming twins of the incremental read and the logs."""
