"""Web-page analytics on Spark DataFrames."""
