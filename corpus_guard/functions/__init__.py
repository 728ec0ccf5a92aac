"""Column functions and SQL expression fragments."""
