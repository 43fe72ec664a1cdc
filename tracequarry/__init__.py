"""Analytics over engineering evidence as Spark jobs."""
