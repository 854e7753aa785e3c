"""Text-to-query data preparation, result comparison and routing analytics on Spark."""
