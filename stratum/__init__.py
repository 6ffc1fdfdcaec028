"""Stratum: content-addressed storage analytics on Spark DataFrames."""
