"""Structured Streaming forms of progress state."""
