"""Structured Streaming forms of what the host appends to while it runs."""
