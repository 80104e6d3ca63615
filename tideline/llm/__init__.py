"""Operators for preparing training text: scoring, joining, searching, mixing, formatting."""
