"""Review-evidence analytics on Spark DataFrames."""
