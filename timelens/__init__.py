"""timelens: look back through system telemetry with Spark DataFrames and streams."""
