"""Dictionary-encoded grid data and the documents that travel with it, on Spark DataFrames."""
