"""gridsmith: reviewed-table analytics expressed as Spark DataFrame jobs."""
