"""tessaly: composite-indicator analytics expressed as Spark DataFrame jobs."""
