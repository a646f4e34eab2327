"""Column functions: text, JSON and vectors."""
