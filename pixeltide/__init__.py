"""Frame, detection and track analytics as Spark DataFrames and streams."""
