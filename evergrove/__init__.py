"""A temporal tree query engine on Spark DataFrames."""
