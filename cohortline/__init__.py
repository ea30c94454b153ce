"""Longitudinal cohort analytics on Spark DataFrames."""
