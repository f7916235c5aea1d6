"""Functions of the netloom engine."""
