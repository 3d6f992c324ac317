"""Feature analytics on Spark DataFrames."""
