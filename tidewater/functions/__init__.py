"""Column expressions: distributions, rounding and interpolation."""
