"""Evidence and training-data analytics, expressed as Spark jobs."""
