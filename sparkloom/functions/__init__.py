"""Scalar functions, user-defined functions, and vectors."""
