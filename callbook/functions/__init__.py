"""functions of the library (see README)."""
