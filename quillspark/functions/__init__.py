"""Column functions: text, names, vectors, geography and JSON."""
