"""Document preparation and retrieval on Spark DataFrames."""
