"""Document retrieval, grounded answers and facility search as Spark jobs."""
