"""sources of the question library."""
