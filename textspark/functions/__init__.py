"""Column expressions: everything here stays inside one row."""
