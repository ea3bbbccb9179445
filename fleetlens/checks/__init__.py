"""Oracle SQL and self checks."""
