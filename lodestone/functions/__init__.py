"""Column expressions: text, URLs, identifiers and dates, arithmetic and units."""
