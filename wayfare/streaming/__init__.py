"""Updates that arrive as a stream."""
