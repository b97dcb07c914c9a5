"""Column expressions: text, similarity and vectors."""
