"""streaming of lodestack."""
