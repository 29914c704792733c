"""Column expressions: all built-ins, no Python functions run per row."""
