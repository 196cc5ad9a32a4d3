"""docstrata: document trees, chunks, vectors and chat logs as Spark jobs."""
