"""Column functions: text and HTML."""
