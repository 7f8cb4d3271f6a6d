"""symlake: code-index analytics on Spark DataFrames."""
