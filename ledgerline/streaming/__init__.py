"""Structured Streaming forms of arrivals, settled weeks and holds."""
