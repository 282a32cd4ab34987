"""emberframe: spatio-temporal risk analytics on Spark DataFrames."""
