"""Route, stop and site analytics on Spark DataFrames."""
