"""Sluice: road-closure analytics on Spark DataFrames."""
