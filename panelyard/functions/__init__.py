"""Column expressions: losses, metrics, bucket formula."""
