"""Operators for training text and very large numeric columns. Nothing outside this package imports it."""
