"""Page extraction, URL expansion, crawling and math normalisation as Spark DataFrame jobs."""
