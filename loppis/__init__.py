"""Marketplace price intelligence on Spark DataFrames."""
