"""Catalogue enrichment, cleaning, vector building and similarity search on Spark DataFrames."""
