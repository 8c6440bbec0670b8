"""Windowed band joins between two tables or streams on Spark, and what surrounds them."""
