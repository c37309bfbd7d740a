"""Optional Structured Streaming variant of the measurement counts."""
