"""Panel-data operators on Spark DataFrames."""
