"""Scalar functions over text, values and similarity."""
