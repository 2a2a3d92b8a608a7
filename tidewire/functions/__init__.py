"""Column functions: each takes and returns Columns, so that Catalyst sees plain expressions."""
