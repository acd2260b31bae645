"""Column functions: identifiers, text, numbers, dates and tag cells."""
