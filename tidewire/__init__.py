"""News-text analytics on Spark."""
