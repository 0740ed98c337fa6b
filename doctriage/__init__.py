"""doctriage: document classification over tables of documents, as Spark jobs."""
