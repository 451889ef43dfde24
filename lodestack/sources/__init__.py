"""sources of lodestack."""
