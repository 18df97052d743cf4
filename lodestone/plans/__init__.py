"""The query language: text to specification to plan."""
