"""Column functions: numbers, matrices, rationals."""
