"""Retrieval, ingest and evaluation over media libraries, on Spark."""
