"""Flight-operations analytics on Spark DataFrames."""
