"""streaming of the library (see README)."""
