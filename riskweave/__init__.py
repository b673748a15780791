"""Operational risk analytics on Spark DataFrames."""
