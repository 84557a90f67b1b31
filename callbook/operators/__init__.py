"""operators of the library (see README)."""
