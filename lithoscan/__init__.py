"""Source-corpus search and analysis on Spark DataFrames."""
