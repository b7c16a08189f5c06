"""Security-finding analytics on Spark."""
