"""Prompt grids and their answers as Spark DataFrames."""
