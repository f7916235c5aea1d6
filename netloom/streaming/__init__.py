"""Streaming of the netloom engine."""
