"""Column expressions: identifiers, titles, nested records, similarity."""
