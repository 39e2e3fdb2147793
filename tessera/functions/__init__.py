"""Scalar functions as Column -> Column; built-in expressions only, so they stay inside code generation."""
