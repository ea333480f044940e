"""sorrel: catalog analytics, ingestion and change monitoring on PySpark."""
