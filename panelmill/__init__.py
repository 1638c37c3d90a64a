"""Panel analytics on PySpark."""
