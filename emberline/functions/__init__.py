"""Column functions: every one takes and returns Spark columns, so plans stay in generated code."""
