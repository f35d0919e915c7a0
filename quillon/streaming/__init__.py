"""Structured Streaming over arriving catalogue rows."""
