"""Signal and audio analytics on Spark DataFrames."""
