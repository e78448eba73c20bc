"""Relational operators of the listing domain."""
