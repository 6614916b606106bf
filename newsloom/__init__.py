"""newsloom: news-feed analytics on Spark DataFrames."""
