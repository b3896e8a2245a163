"""Relational and iterative operators, DataFrame to DataFrame."""
