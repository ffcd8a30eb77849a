"""Timeline analytics on PySpark: observations, display intervals, alignment, blocks, gaps and their reports."""
