"""Product-catalog retrieval and request analytics as Spark jobs."""
