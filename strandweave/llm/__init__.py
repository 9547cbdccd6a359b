"""Operators for language-model training text; nothing outside this package imports it."""
