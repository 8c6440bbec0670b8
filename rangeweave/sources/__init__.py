"""Readers and writers for batches and streams."""
