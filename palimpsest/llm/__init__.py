"""Training-data operators on PySpark.  Nothing outside this package imports it."""
