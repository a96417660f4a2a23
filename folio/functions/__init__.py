"""Column functions: text, URLs, content types and families."""
