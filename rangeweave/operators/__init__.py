"""Joins and what stands in for the in-memory index."""
