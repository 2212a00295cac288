"""Documentation-corpus indexing and retrieval as Spark jobs."""
