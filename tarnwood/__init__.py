"""Program-analysis and findings analytics on Spark DataFrames."""
