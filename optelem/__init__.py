"""optelem: operational-telemetry analytics as Spark DataFrame and Structured Streaming operators."""
