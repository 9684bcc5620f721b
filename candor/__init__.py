"""Truth discovery over free text, on Spark DataFrames."""
