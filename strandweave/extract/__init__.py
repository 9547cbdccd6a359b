"""Symbols and relations of source files."""
