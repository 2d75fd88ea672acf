"""Column expressions and domain functions."""
