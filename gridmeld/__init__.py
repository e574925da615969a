"""Gridded-field alignment, neighbourhood scoring and prediction evaluation on Spark DataFrames."""
