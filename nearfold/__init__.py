"""Near-duplicate detection, resolution and corpus preparation on Spark."""
