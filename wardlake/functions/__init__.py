"""Column-level building blocks; all are native Spark expressions."""
