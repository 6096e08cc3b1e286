"""Applicability, validation and training-data analytics on Spark DataFrames."""
