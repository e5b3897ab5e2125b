"""Polyline analytics on Spark DataFrames."""
