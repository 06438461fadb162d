"""Document intelligence, retrieval and corpus preparation expressed as Spark DataFrame jobs."""
