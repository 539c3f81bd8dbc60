"""Scalar functions: record, list and number grammars as Column expressions."""
