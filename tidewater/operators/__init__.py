"""Operators from DataFrame to DataFrame; key columns are parameters."""
