"""Column expressions: payload parsers and scalar helpers."""
