"""fathomkb: evidence-backed knowledge analytics on Spark DataFrames."""
