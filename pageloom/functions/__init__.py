"""Column expressions: everything here is built-in Spark SQL, no Python per row."""
