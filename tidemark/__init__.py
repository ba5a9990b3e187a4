"""Point-in-time signal research operators on Spark DataFrames."""
