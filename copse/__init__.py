"""Structural queries over ordered forests in Spark DataFrames."""
