"""Address-reconciliation analytics on Spark: DataFrame operators, sources, reports and streaming jobs."""
