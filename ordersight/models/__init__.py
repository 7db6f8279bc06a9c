"""Models fitted and applied by Spark jobs."""
