"""Column expressions: geometry, projection, text, colour."""
