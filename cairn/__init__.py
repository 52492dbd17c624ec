"""Point-cloud and vector analytics on Spark DataFrames."""
