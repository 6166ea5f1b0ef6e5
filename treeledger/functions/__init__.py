"""Column expressions: every function here takes and returns Spark columns and stays inside code generation."""
