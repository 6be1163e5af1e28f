"""Campaign scoring and analytics as Spark DataFrame jobs."""
