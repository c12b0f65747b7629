"""Document-review analytics on PySpark DataFrames."""
