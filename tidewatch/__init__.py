"""Early-warning analytics on event tables, written as Spark DataFrame jobs."""
