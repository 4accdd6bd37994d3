"""Column expressions: identity, numbers, strings, dates, similarity."""
