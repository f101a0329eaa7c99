"""Spark transforms for archives of astronomical images."""
