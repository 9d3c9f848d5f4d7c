"""Column functions and small value types."""
