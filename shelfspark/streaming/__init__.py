"""Structured Streaming jobs over change events."""
