"""Scalar functions, as columns and, for single search texts, as plain Python."""
