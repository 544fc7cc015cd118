"""Cloud-resource inventory analytics on Spark DataFrames."""
