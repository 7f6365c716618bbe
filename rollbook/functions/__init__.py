"""Column expressions: text, dates, JSON and numbers."""
