"""Structured Streaming around the band join."""
