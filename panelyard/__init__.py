"""Cross-sectional panel analytics as plain Spark DataFrame operators."""
