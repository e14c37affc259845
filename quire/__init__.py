"""Document analytics on Spark: packaged books and web pages as tables."""
