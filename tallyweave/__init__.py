"""Crawl-metadata cube analytics on Spark."""
