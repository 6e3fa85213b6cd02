"""Spark-first analytics for services that process files in jobs."""
