"""operators of lodestack."""
