"""Connected components, as the engine's graph kernel makes them."""

from netloom.operators.graph import connected_components

__all__ = ["connected_components"]
