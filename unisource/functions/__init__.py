"""Column expressions: text, types and JSON helpers."""
