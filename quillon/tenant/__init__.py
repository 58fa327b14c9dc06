"""One tenant's view of the engine."""
