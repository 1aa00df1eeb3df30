"""Streaming forms of the incremental steps."""
