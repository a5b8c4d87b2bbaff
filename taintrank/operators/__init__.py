"""Relational operators of the library (see README for the SURVEY ids)."""
