"""Scholarly-graph analytics on Spark DataFrames."""
