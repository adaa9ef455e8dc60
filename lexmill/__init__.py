"""Text analytics over Spark DataFrames."""
