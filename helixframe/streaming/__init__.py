"""Structured Streaming jobs over reads."""
