"""Due-diligence analytics on farm plots, as Spark DataFrame jobs."""
