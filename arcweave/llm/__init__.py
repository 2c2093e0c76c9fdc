"""Operators for large-scale text and training-data work. Nothing outside this package imports it."""
