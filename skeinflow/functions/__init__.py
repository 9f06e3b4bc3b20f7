"""Column functions: text, URLs, HTML, JSON, vectors."""
