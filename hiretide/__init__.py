"""Job-postings analytics as Spark jobs."""
