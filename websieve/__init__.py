"""Standing-query analytics over crawled web pages, on PySpark."""
