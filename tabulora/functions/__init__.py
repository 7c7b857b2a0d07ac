"""Column functions: text, numbers, tokens, vectors and report metadata."""
