"""Plans of the netloom engine."""
