"""Crawl-corpus processing and ranked text search as Spark jobs."""
