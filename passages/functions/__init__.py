"""Column expressions: text, hashing, vectors, ranking and parsing."""
