"""Error-bounded array analytics on Spark."""
