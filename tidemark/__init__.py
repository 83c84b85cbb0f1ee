"""Point-in-time event studies and corpus preparation as lazy Spark DataFrames."""
