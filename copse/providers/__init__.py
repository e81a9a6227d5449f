"""Parsers of source code, and the kinds that selectors use for each language."""
