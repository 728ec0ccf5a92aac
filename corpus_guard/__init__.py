"""Security and privacy findings over tables of text, as PySpark DataFrame operations."""
