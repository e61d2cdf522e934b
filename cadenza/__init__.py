"""Position-indexed sequence analytics as Spark DataFrames."""
