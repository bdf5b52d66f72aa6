"""Snapshot-delta analytics on Spark DataFrames."""
