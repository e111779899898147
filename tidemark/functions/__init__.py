"""Column functions: text, time, vectors, scores."""
