"""Readers of dumps, listings, uploads and the tables of the model."""
