"""Column expressions and parameter tables."""
