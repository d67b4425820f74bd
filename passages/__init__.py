"""Passages: section retrieval and terminology mining as Spark DataFrame jobs."""
