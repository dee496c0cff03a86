"""Table-cleaning analytics on Spark DataFrames."""
