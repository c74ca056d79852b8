"""textlathe: text search, evaluation analytics and record repair on Spark DataFrames."""
