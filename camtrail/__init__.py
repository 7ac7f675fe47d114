"""Detection analytics for field imagery on Spark."""
