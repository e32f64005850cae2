"""Column expressions: time fields, geometry and vectors."""
