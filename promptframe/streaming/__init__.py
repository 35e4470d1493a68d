"""Structured Streaming jobs over batch answers and the result log."""
