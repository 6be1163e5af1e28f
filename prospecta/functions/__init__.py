"""Column expressions: scalars, validation rules and row keys."""
