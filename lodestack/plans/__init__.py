"""plans of lodestack."""
