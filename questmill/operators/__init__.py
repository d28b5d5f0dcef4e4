"""operators of the question library."""
