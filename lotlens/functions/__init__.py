"""Column functions: coercions, presence tests, text parsers, identity and hashing."""
