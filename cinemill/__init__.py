"""Media-library analytics as Spark DataFrames."""
