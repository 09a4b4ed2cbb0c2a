"""Scalar functions as Column expressions, and the two Arrow functions over pixels."""
