"""evalspark: Spark operators for evaluating model answers at scale."""
