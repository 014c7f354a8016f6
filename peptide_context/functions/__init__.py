"""Column expressions on sequences."""
