"""Product-catalogue analytics written on Spark DataFrames and Structured Streaming."""
