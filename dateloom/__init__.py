"""Document-date analytics and corpus preparation on Spark DataFrames."""
