"""Operators of the netloom engine."""
