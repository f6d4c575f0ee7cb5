"""leadloom: a Spark-first engine that turns raw postings, pages and provider records into ranked leads."""

__version__ = "0.1.0"
