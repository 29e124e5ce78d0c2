"""Incremental and Structured Streaming forms."""
