"""Analytics for free-text support records on Spark."""
