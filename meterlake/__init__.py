"""Usage and cost analytics on Spark."""
