"""Column expressions and rules on column names."""
