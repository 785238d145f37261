"""Operators on text and on similarity of records."""
