"""Column builders: every function here takes and returns Spark columns."""
