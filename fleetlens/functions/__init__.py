"""Column expressions (scalar helpers, statistics)."""
