"""Analytics of ordered media-like data as Spark DataFrames."""
