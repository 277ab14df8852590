"""Column expressions: text, languages and vectors."""
