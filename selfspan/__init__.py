"""Feature-table preparation, subspace clustering and cluster evaluation on Spark DataFrames."""
