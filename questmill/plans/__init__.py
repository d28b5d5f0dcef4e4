"""plans of the question library."""
