"""Column functions.  All are built from Spark's own expressions, so they stay in generated code."""
