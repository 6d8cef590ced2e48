"""Analytics over sequencing reads on Spark DataFrames."""
