"""Review analytics and retrieval, written as Spark jobs."""
