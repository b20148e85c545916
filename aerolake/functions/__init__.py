"""Part of the flight-telemetry library."""
