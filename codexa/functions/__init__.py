"""Column functions: names, identifiers, numbers, dates and similarity."""
