"""Nursing-home staffing and quality analytics as lazy Spark DataFrames."""
