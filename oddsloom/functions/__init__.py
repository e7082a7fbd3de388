"""Column expressions. Each takes columns (or names) and returns a column."""
