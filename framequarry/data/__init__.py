"""Fixed values that results depend on, in natural order."""
