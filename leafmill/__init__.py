"""leafmill: DataFrame operators for document collections on Spark."""
