"""Scalar formulas as Column expressions."""
