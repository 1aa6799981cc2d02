"""Column expressions and exact distributed building blocks."""
