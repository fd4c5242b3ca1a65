"""Column expressions: levels, tags, text and time formatting, host classes."""
