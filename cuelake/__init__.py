"""Timeline and text analytics on PySpark."""
