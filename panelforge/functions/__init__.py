"""Column expressions, free of any DataFrame."""
