"""Profiling, relationship discovery and calculation engine on Spark DataFrames."""
