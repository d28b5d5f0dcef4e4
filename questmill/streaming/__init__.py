"""streaming of the question library."""
