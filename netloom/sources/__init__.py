"""Sources of the netloom engine."""
