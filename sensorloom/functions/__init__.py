"""Column expressions of the sensor domain."""
