"""Vector similarity search for Spark DataFrames: exact and approximate."""
