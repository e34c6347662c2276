"""Saved-article archive engine on Spark DataFrames."""
