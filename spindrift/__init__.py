"""Analytics and data preparation on Spark DataFrames."""
