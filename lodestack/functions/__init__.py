"""functions of lodestack."""
