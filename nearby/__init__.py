"""Local listings and places on Spark DataFrames."""
