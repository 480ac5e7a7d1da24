"""Governed-graph analytics on Spark DataFrames."""
