"""Column functions that stay inside generated code."""
