"""Field-boundary analytics and data preparation, as Spark jobs."""
