"""Catalogue analytics and recommendations on Spark DataFrames."""
