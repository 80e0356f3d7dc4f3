"""Discover, catalogue and query business data sources with Spark DataFrames."""
