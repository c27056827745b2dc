"""Column expressions: masking, literals, identifiers, type mapping."""
