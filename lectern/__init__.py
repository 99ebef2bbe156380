"""Document retrieval and reading analytics on Spark DataFrames."""
