"""Column functions: geometry, text, tags, rules."""
