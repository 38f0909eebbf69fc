"""Contract-register analytics and training-data preparation as Spark jobs."""
