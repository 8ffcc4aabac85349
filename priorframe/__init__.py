"""Leak-free temporal analytics on Spark DataFrames."""
