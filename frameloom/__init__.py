"""Episode-structured analytics on Spark DataFrames."""
