"""Content analytics on Spark: collections of posts as DataFrames, and what a publication asks of them."""
