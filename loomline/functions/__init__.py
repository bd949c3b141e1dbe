"""Column expressions. Each takes and returns a Spark `Column`."""
