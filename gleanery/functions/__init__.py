"""Column builders for text, vectors and statistics."""
