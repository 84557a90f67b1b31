"""sources of the library (see README)."""
