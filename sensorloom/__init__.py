"""Room and device sensor analytics as plain Spark DataFrame operators."""
