"""Flight-telemetry analytics over Spark DataFrames: many flights at once, relational first."""
