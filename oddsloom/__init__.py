"""Point-in-time match analytics and odds evaluation on Spark DataFrames."""
